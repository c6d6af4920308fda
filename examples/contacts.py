"""A contact book that survives restarts: python examples/contacts.py FOLDER [list | add NAME EMAIL PHONE | drop NAME]."""

import sys

from pyspark.sql import SparkSession

from keelstate.schema import collection, derive
from keelstate.store import Store


@derive
class ContactBook:
    people = collection(0, "k string", "name string, email string, phone string")


def main(folder: str, command: str = "list", *args: str) -> None:
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
    with Store.open(spark, ContactBook, folder) as store:
        if command == "add":
            name, email, phone = args
            store.write(lambda tx: tx.people.put(name.lower(), (name, email, phone)))
        elif command == "drop":
            print("dropped" if store.write(lambda tx: tx.people.delete(args[0].lower())) else "not there")
        for row in store.read().iterate("people").collect():
            print(f"{row.name}\t{row.email}\t{row.phone}")


if __name__ == "__main__":
    main(*sys.argv[1:])

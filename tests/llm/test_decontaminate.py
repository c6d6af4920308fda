import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelstate.llm import decontaminate as op
from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width=8):
    wins = {}
    for item, text in items:
        w = split(text)
        if item is not None and w:
            for i in range(max(1, len(w) - width + 1)):
                wins.setdefault(tuple(w[i : i + width]), set()).add(item)
    out = []
    for doc_id, text in docs:
        w, hit, found = split(text), set(), set()
        for win, of in wins.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= of
        sha = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, len(found) >= 2))
    return sorted(out, key=repr)


def case(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 8, 9, 20])))) for i in range(12)]
    items += [(3, items[3][1]), (None, "w1 w2"), (40, None)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 7, 30, 80])))) for i in range(30)]
    docs += [(100 + i, f"Pre, {items[i][1].upper()}! post") for i in range(12)]
    docs += [docs[0], (None, docs[-1][1])]
    return docs, items


@pytest.mark.parametrize("block", [200_000, 7])
def test_equals_brute_force(spark, frame, block):
    docs, items = case(block)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = op.scan(frame(docs), bench, block_windows=block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)
    for least in (1, 2):
        kept = op.remove(frame(docs), bench, min_items=least, block_windows=block)
        assert kept.columns == frame(docs).columns
        want = [d[0] for d in brute(docs, items) if d[3] < least]
        assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted(want, key=repr)


def test_rows_are_removed_by_their_own_text_at_every_block_size(spark, frame):
    leak = "one two three four five six seven eight nine ten"
    rows = [(None, "clean one"), (None, leak), (5, "clean two"), (5, leak + " more"), (5, None), (6, "ok"), (None, None), (6, "ok")]
    bench = spark.createDataFrame([(1, leak), (2, "a b c d e f g h i j k"), (3, "l m n o p q r s t")], "item_id long, text string")
    want = sorted(((i, t) for i, t in rows if leak not in (t or "")), key=repr)
    for size in (200_000, 7, 2, 1):
        assert sorted(((r.doc_id, r.text) for r in op.remove(frame(rows), bench, block_windows=size).collect()), key=repr) == want
    plan = op.scan(frame(rows), bench, block_windows=2)._jdf.queryExecution().executedPlan().toString()
    assert "text#" not in plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=9), min_size=1, max_size=6))
def test_search_finds_every_occurrence(doc, patterns):
    words = [str(w).encode() for w in doc]
    search = op.Search((i, tuple(str(w).encode() for w in p)) for i, p in enumerate(patterns))
    spans, items = search.document(words)
    hit = {p for a, b in spans for p in range(a, b)}
    want, found = set(), set()
    for i, p in enumerate(patterns):
        for at in range(len(doc) - len(p) + 1):
            if doc[at : at + len(p)] == p:
                want.update(range(at, at + len(p)))
                found.add(i)
    assert hit == want and items == found


def test_odd_inputs(spark, odd, no_docs):
    bench = spark.createDataFrame([(1, "two words"), (2, "one"), (3, "")], "item_id long, text string")
    got = op.scan(odd, bench).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(ODD, [(1, "two words"), (2, "one"), (3, "")])
    assert op.scan(no_docs, bench).count() == 0
    nothing = op.scan(odd, bench.limit(0)).collect()
    assert all(r.n_hit == 0 and not r.contaminated for r in nothing) and len(nothing) == len(ODD)

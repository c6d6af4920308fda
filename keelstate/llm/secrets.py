"""Secret scan: candidates by pattern, false positives removed by a random forest. SQL functions only.

Candidates are quoted strings without blanks, values assigned to a name that hints at a secret or
sent as a bearer's token, and long runs of token characters, parts joined by dots among them; none
has an upper length. The forest judges each from its length, its character classes and their
transitions, how much of it common letter pairs and dictionary words cover, whether it stands in a
path, and the words around it. It is trained from a table of labelled findings, which is made here
by rule.

Defined results: a null or empty text has no candidates; candidates don't overlap, and the leftmost
stands, the first kind at its place; repeated rows are answered one by one; an empty table gives no
rows; the two control characters that mark candidates count as blanks in a text; only doc_id and
text are read, so other columns may have any name. An offset counts characters from 0; a finding is
shown as its first four characters and its SHA-256.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstate.llm import common

#: Share of the trees from which a candidate is kept.
THRESHOLD = 0.5
#: Trees and depth of the forest, rows of the labelled table, words of context to each side, and pieces
#: of a text whose lengths are summed one by one.
TREES, DEPTH, LABELLED, CONTEXT, SUMMED = 24, 7, 6000, 6, 256

OPEN, SHUT = "\u0001", "\u0002"
#: What stands before an unquoted value (group 1), such a value (2), and what is a candidate anywhere (3).
CANDIDATE = (
    r"""((?<![A-Za-z0-9_-])[A-Za-z0-9_-]{0,40}?(?i:passw(?:or)?d|passwd|pwd|secret|token|key|auth|credentials?) {0,2}[=:] {0,2}|[Bb]earer )"""
    r"""([^\s"',;=:\x01\x02][^\s"',;\x01\x02]{7,})"""
    r"""|(["'][^\s"'\x01\x02]{8,}["']|[A-Za-z0-9+/_-]{16,}(?:\.[A-Za-z0-9+/_-]{4,}){0,8}={0,2})"""
)

#: Common words of prose and code, and common letter pairs.
WORDS = (
    "the and for with that this from have not are was were will would can could should one all has had but they you "
    "her his she him our out who which their there been more when what some time into other than then these two may "
    "about over new work first also after back use how well way want because any give day most get set has config data "
    "file name path user path test main index value table string number list item type class function return import "
    "module package version license copyright apache software image style script page link title content header footer "
    "der die das und ist nicht mit den dem von sich auf ein eine les des une est que pour dans pas sur par los las del "
    "para con por una como example sample dummy placeholder change your insert todo none null true false default"
).split()
PAIRS = (
    "th he in er an re on at en nd ti es or te ed is it al ar st nt ng se ha ou le ch de ei ie un qu ai os as ci ea ve "
    "ly el ra ro li ic ne me to ll be ma la ta co no"
).split()
CUES = "key|token|secret|passw|passwd|pwd|auth|bearer|credential|api|private|access"
INNOCENT = "commit|sha|md5|checksum|digest|hash|uuid|guid|revision|etag|integrity|isbn|data:|base64,|build|image"
HOLLOW = "example|sample|dummy|placeholder|change|your|insert|todo|xxxx|0000|1234567|abcdef|\\*\\*\\*|test"

FEATURES = (
    "length digits lower upper marks hex runs pairs words distinct slashes dots "
    "in_path after_path cue assigned quoted innocent hollow prefixed"
).split()


def _left(text: Column, pattern: str) -> Column:
    """Length of what stays when the pattern is taken out."""
    return F.length(F.regexp_replace(text, pattern, ""))


def with_features(rows: DataFrame) -> DataFrame:
    """Adds FEATURES to rows of value, before and after."""
    v, low, before, after = F.col("value"), F.lower(F.col("value")), F.lower(F.col("before")), F.col("after")
    size = F.greatest(F.length(v), F.lit(1)).cast("double")
    collapsed = v
    for pattern, mark in (("[0-9]+", "0"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[^0aA]+", "-")):
        collapsed = F.regexp_replace(collapsed, pattern, mark)
    near = F.substring_index(before, "\n", -1)
    found = {
        "length": F.log2(size),
        "digits": 1 - _left(v, "[0-9]") / size,
        "lower": 1 - _left(v, "[a-z]") / size,
        "upper": 1 - _left(v, "[A-Z]") / size,
        "marks": _left(v, "[A-Za-z0-9]") / size,
        "hex": 1 - _left(low, "[0-9a-f]") / size,
        "runs": F.length(collapsed) / size,
        "pairs": 1 - _left(low, "|".join(PAIRS)) / size,
        "words": 1 - _left(low, "|".join(sorted(WORDS, key=len, reverse=True))) / size,
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(size, F.lit(64.0)),
        "slashes": _left(v, "[^/]") / size,
        "dots": _left(v, "[^.]") / size,
        "in_path": (before.rlike(r"(://|www\.|[/\\.@])\S*$") | v.rlike("^/|^https?:|^\\.\\.?/")).cast("double"),
        "after_path": after.rlike(r"^[./@\\]\w").cast("double"),
        "cue": near.rlike(f"({CUES})[^ ]{{0,12}}[\"' =:>(]{{1,5}}$").cast("double"),
        "assigned": near.rlike(r"[=:]\s{0,2}[\"']?$").cast("double"),
        "quoted": (F.col("quoted_value") | before.rlike("[\"']$")).cast("double"),
        "innocent": near.rlike(f"({INNOCENT})[\"' =:-]{{0,4}}\\S{{0,12}}$").cast("double"),
        "hollow": low.rlike(HOLLOW).cast("double"),
        "prefixed": v.rlike(r"^(AKIA|ASIA|ghp_|gho_|xox[abp]-|sk_live_|sk-|AIza|eyJ|glpat-|npm_)").cast("double"),
    }
    return rows.withColumns(found)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, value (without quotes), before, after and quoted_value of each candidate.

    Marks put around the candidates cut the text into pieces: every other piece is a candidate, its
    neighbours, with the candidate before, are the context. Offsets are sums of the pieces' lengths,
    taken over runs of SUMMED pieces, so a text's candidates are neither gathered nor ordered.
    """
    text = F.translate(F.col("text").cast("string"), OPEN + SHUT, "  ")
    cut = F.split(F.regexp_replace(text, CANDIDATE, f"$1{OPEN}$2$3{SHUT}"), f"[{OPEN}{SHUT}]")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    pieces = docs.select(doc_id, F.filter(F.array(cut), lambda x: F.size(x) > 2).alias("cut")).select("doc_id", F.explode("cut").alias("pieces"))
    lengths = pieces.withColumn("lengths", F.transform("pieces", lambda x: F.length(x).cast("long")))

    def summed(start: Column, many: Column, of: str) -> Column:
        return F.aggregate(F.slice(of, start, many), F.lit(0).cast("long"), lambda x, y: x + y)

    runs = F.sequence(F.lit(0), F.floor(F.size("pieces") / SUMMED).cast("int"))
    blocks = lengths.withColumn("blocks", F.transform(runs, lambda i: summed(i * SUMMED + 1, F.lit(SUMMED), "lengths")))
    sums = blocks.withColumn("sums", F.transform(runs, lambda i: summed(F.lit(1), i, "blocks")))
    at = F.sequence(F.lit(2), F.size("pieces") - 1, F.lit(2))

    def start_of(i: Column) -> Column:
        run = F.floor((i - 1) / SUMMED).cast("int")
        return F.element_at("sums", run + 1) + summed(run * SUMMED + 1, i - 1 - run * SUMMED, "lengths")

    def candidate(i: Column) -> Column:
        gap, earlier = F.element_at("pieces", i - 1), F.when(i > 2, F.element_at("pieces", i - 2)).otherwise("")
        return F.struct(
            F.element_at("pieces", i).alias("raw"),
            F.substring_index(F.concat(earlier, gap), " ", -CONTEXT).alias("before"),
            F.substring_index(F.element_at("pieces", i + 1), " ", CONTEXT).alias("after"),
            start_of(i).alias("start"),
        )

    found = sums.select("doc_id", F.inline(F.transform(at, candidate)))
    quoted = F.col("raw").rlike("^[\"']")
    return found.select(
        "doc_id",
        (F.col("start") + quoted.cast("int")).cast("long").alias("start"),
        F.when(quoted, F.expr("substring(raw, 2, length(raw) - 2)")).otherwise(F.col("raw")).alias("value"),
        "before",
        "after",
        quoted.alias("quoted_value"),
    )


def labelled_findings(spark: SparkSession, rows: int = LABELLED) -> DataFrame:
    """The training table: value, before, after, quoted_value and label (1 for a secret), by rule.

    Row i takes the shape numbered i mod the number of shapes; its characters come from digests of i.
    """
    digest = "sha2(cast(id as string), 256)"
    mixed = f"translate(base64(unhex({digest})), '+/=', 'aZ9')"
    syllables = "array('ba','kor','mi','sel','tu','vo','gar','pli','den','fos','hul','ja','kre','lom','nip','os','quar','ru','sik','we')"
    word = "concat(" + ", ".join(f"element_at({syllables}, cast(pmod(xxhash64(id, {i}), 20) as int) + 1)" for i in range(7)) + ")"
    part = "concat(" + ", ".join(f"element_at({syllables}, cast(pmod(xxhash64(id, {i}), 20) as int) + 1)" for i in range(3)) + ")"
    title = f"initcap({part})"
    number = "lpad(cast(pmod(xxhash64(id, 'n'), 10000000000000000) as string), 16, '0')"
    upper = f"upper(substring(translate({mixed}, 'abcdefghijk', 'QRSTUVWXYZA'), 1, 16))"
    cue = "element_at(array('token','api_key','secret','auth_token','access_key','secret_key'), cast(pmod(xxhash64(id, 'c'), 6) as int) + 1)"
    join = "element_at(array(' = ',': ','=',' : '), cast(pmod(xxhash64(id, 'j'), 4) as int) + 1)"
    shapes = [  # (value, before, after, quoted, label)
        (f"substring({digest}, 1, 40)", f"concat({part}, ' ', {cue}, {join})", f"concat(' ', {part})", True, 1),
        (f"substring({digest}, 1, 32)", f"concat({cue}, {join})", "''", False, 1),
        (f"substring({mixed}, 1, 40)", f"concat({part}, ' ', {cue}, {join})", f"concat(' ', {part})", True, 1),
        (f"concat('AKIA', {upper})", f"concat({part}, ' ')", f"concat(' ', {part})", False, 1),
        (f"concat('ghp_', substring({mixed}, 1, 36))", f"concat({part}, {join})", "''", False, 1),
        (f"concat('sk_live_', substring({mixed}, 1, 24))", f"concat({part}, ' ')", f"concat(' ', {part})", True, 1),
        (f"concat(substring({mixed}, 1, 12), '!', substring({mixed}, 20, 3))", f"concat('password', {join})", f"concat(' ', {part})", True, 1),
        (f"concat('eyJhbGci', {mixed}, {mixed})", "'Authorization: Bearer '", f"concat(' ', {part})", False, 1),
        (f"concat(substring({mixed}, 1, 9), '!', substring({mixed}, 20, 4))", f"concat('password', {join})", f"concat(' ', {part})", False, 1),
        (f"concat(substring({mixed}, 1, 12))", f"concat({part}, ' ', {cue}, {join})", "''", False, 1),
        (f"concat('eyJhbGci', substring({mixed}, 1, 20), '.eyJ', {mixed}, '.', {mixed})", "'Authorization: Bearer '", f"concat(' ', {part})", False, 1),
        (f"concat({mixed}, {mixed}, '#', {mixed}, {mixed}, {mixed})", f"concat({cue}, {join})", "''", True, 1),
        (f"concat('my_', {part}, '_access_key')", f"concat({part}, ' ')", "' = '", False, 0),
        (f"concat({part}, {part}, '.', {part}, '.', {part})", f"concat('import ', '')", f"concat(' ', {part})", False, 0),
        (f"concat('<', {part}, '>')", f"concat({cue}, {join})", "''", False, 0),
        (f"concat({part}, '_', {part})", f"concat({cue}, {join})", f"concat(' ', {part})", False, 0),
        (word, f"concat({part}, ' ', {part}, ' ')", f"concat(' ', {part})", False, 0),
        (word, f"concat({part}, ' ', {part}, ' ')", f"concat(', ', {part})", True, 0),
        (f"upper({word})", f"upper(concat({part}, ' ', {part}, '!! '))", f"upper(concat('. ', {part}))", False, 0),
        (f"concat({title}, {title}, {title})", f"concat({part}, ' ')", "'('", False, 0),
        (f"concat({part}, '_', {part}, '_', {part})", f"concat('def ', '')", "'('", False, 0),
        (f"concat('/', {part}, '/', {part}, '/', {part})", f"concat('https://', {part}, '.example.com')", "'.html'", False, 0),
        (f"concat({part}, '-', {part}, '-', {part})", "'src/'", "'.py'", False, 0),
        (f"substring({digest}, 1, 40)", f"concat({part}, ' commit ')", f"concat(' ', {part})", False, 0),
        (f"substring({digest}, 1, 32)", "'md5: '", "''", True, 0),
        (digest, "'sha256:'", "''", False, 0),
        (
            f"concat_ws('-', substring({digest},1,8), substring({digest},9,4), substring({digest},13,4), substring({digest},17,4), substring({digest},21,12))",
            "'uuid = '", "''", True, 0,
        ),
        (number, f"concat({part}, ' ')", f"concat(' ', {part})", False, 0),
        (number, f"concat({part}, ' ', {part}, '. ')", f"concat(' ', {part})", False, 0),
        (f"concat('your_', {part}, '_here_xxxx')", f"concat({cue}, {join})", "''", True, 0),
        ("'xxxxxxxxxxxxxxxxxxxx'", f"concat({cue}, {join})", "''", True, 0),
        (f"concat('AKIA', 'EXAMPLE', {part}, '0000')", f"concat({cue}, {join})", "''", True, 0),
        (f"concat({mixed}, {mixed}, {mixed})", "'src=data:image/png;base64,'", "''", False, 0),
        ("repeat('-', 20 + cast(pmod(id, 30) as int))", "'\n'", "'\n'", False, 0),
        (f"concat({title}, '-', {title}, '-', {part})", f"concat({part}, ' ')", f"concat(' ', {part})", False, 0),
        (f"concat({part}, '.', {part}, '.css')", "'href='", "'>'", True, 0),
        (f"concat('{{', {part}, '}}')", f"concat({cue}, {join})", "''", True, 0),
    ]
    made = None
    for number, (value, before, after, quoted, label) in enumerate(shapes):
        ids = spark.range(number, rows, len(shapes), 1)  # a plan of its own for each shape keeps generated code small
        part = ids.select(
            F.expr(value).alias("value"),
            F.expr(before).alias("before"),
            F.expr(after).alias("after"),
            F.lit(quoted).alias("quoted_value"),
            F.lit(float(label)).alias("label"),
        )
        made = part if made is None else made.unionAll(part)
    common.prepare(spark)
    return made.coalesce(2).checkpoint()


def fit(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> PipelineModel:
    """The forest of a labelled table of findings."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=32, seed=7, minInstancesPerNode=2)
    rows = assembler.transform(with_features(findings)).select("features", "label")
    model = forest.fit(rows)
    # The summary of the training refers to the session, which can't travel to the executors with the trees.
    model._java_obj.setSummary(findings.sparkSession._jvm.scala.Option.empty())
    return PipelineModel([assembler, model])


def judge(found: DataFrame, model: PipelineModel) -> DataFrame:
    """Candidates with the forest's score."""
    return model.transform(with_features(found)).withColumn("score", vector_to_array("probability")[1])


def scan(docs: DataFrame, model: PipelineModel, threshold: float = THRESHOLD) -> DataFrame:
    """The findings that the forest keeps: doc_id, their place, a masked view, a digest and the score."""
    value = F.col("value")
    return (
        judge(candidates(docs), model)
        .filter(F.col("score") >= threshold)
        .select(
            "doc_id",
            "start",
            (F.col("start") + F.length(value)).alias("end"),
            F.concat(F.left(value, F.lit(4)), F.lit("...")).alias("shown"),
            F.sha2(value.cast("binary"), 256).alias("value_sha256"),
            "score",
        )
    )

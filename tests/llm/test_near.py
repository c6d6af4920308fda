import random
import time

import numpy as np

import corpus_pipeline
from keelstate.llm import near as op
from tests.llm.conftest import ODD


def slow_components(docs):
    sets = []
    for _, text in docs:
        words = (text or "").lower().split()
        width = min(5, len(words))
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else {()})
    group = list(range(len(docs)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, least.get(root(i))) for i, (d, _) in enumerate(docs)), key=repr)


def corpus():
    """Texts with chains of near copies: each has a few words of the one before changed."""
    rng = random.Random(5)
    docs = []
    for _ in range(40):
        words = [f"w{rng.randrange(900)}" for _ in range(rng.choice([2, 4, 60, 200]))]
        for _ in range(rng.choice([1, 3, 6])):
            docs.append(" ".join(words))
            words = list(words)
            for _ in range(1 + len(words) // 60):
                words[rng.randrange(len(words))] = f"new{rng.randrange(900)}"
    rng.shuffle(docs)
    return list(enumerate(docs + docs[:5]))


def test_stage_drops_near_copies_as_brute_force(spark, frame, sf_dir):
    docs = corpus()
    want = slow_components(docs)
    assert sorted((tuple(r) for r in op.clusters(frame(docs)).collect()), key=repr) == want
    kept = corpus_pipeline.near_duplicate_stage(spark, frame(docs), sf_dir)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want})


def test_blocks_keep_every_component(spark, frame):
    docs = corpus()
    rows = frame(docs)
    sets = {i: op.shingles(text.encode()) for i, text in docs}
    made = {op._node(s): (i, s) for i, s in reversed(sets.items())}
    signed = lambda x: int(np.uint64(x).view(np.int64))
    table = [(signed(k), i, len(s), signed(op.majority(s)), op.bands(s).view(np.int64).tolist()) for k, (i, s) in made.items()]
    nodes = spark.createDataFrame(table, "fp long, least long, n int, simhash long, bands array<long>")
    whole, cut = ({(r.node, r.root) for r in op.joined(rows, nodes, n).collect()} for n in (512, 2))
    assert whole == cut and whole


def test_odd_inputs(odd, no_docs):
    assert sorted((tuple(r) for r in op.clusters(odd).collect()), key=repr) == slow_components(ODD)
    assert op.clusters(no_docs).count() == 0


def test_no_shuffle_files_of_finished_steps_stay(spark, frame):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles
    held = lambda: {name for name in str(files().mkString(" ")).split() if "/shuffle_" in name}
    before = held()
    groups = op.groups(frame(corpus()))
    until = time.time() + 10
    while held() - before and time.time() < until:  # executors delete them soon after
        time.sleep(0.1)
    assert not held() - before
    assert groups.count() == len(corpus())
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"

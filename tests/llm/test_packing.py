import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keelstate.llm import packing as op
from tests.llm.conftest import ODD

@pytest.fixture(scope="module")
def counter():
    return op.Counter(op.vocabulary())


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(op.VOCABULARY.replace(".tiktoken", ".json"))


@settings(max_examples=200, deadline=None)
@given(text=st.one_of(st.text(max_size=40), st.text("ab c'sll \n\t12½é_-!", max_size=40)))
def test_counts_equal_another_library(counter, tokenizer, text):
    assert counter.count(text) == len(tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_bins_hold_what_they_say(lengths):
    lengths = sorted(lengths, reverse=True)
    bins, sizes, held = op.Packer((8, 16, 32, 64)).pack(lengths)
    for i, (size, n) in enumerate(zip(sizes, held)):
        assert n == sum(x for x, b in zip(lengths, bins) if b == i) and 0 < n <= size
        assert size == min(s for s in (8, 16, 32, 64) if s >= n)  # downsized


def test_cost_decides_the_size_opened():
    lengths = [20] * 3
    _, sizes, _ = op.Packer((32, 64), cost=lambda size: size).pack(lengths)
    assert sizes == [64]
    _, sizes, _ = op.Packer((32, 64), cost=lambda size: size**2).pack(lengths)
    assert sizes == [32, 32, 32]


def test_waste_is_small():
    rng = random.Random(4)
    lengths = sorted((min(8192, int(rng.lognormvariate(6, 1)) + 1) for _ in range(3000)), reverse=True)
    _, sizes, held = op.Packer().pack(lengths)
    assert sum(held) / sum(sizes) > 0.98
    single = sum(min(s for s in op.SIZES if s >= n) for n in lengths)
    assert sum(sizes) < single


def test_every_token_is_packed_once(spark, frame, counter):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(0, 300)))) for i in range(200)]
    rows += [(500, "word " * 700), (7, rows[7][1]), (None, "null id")]
    got = op.pack(frame(rows), sizes=(64, 128, 256), shard=40).collect()
    want = sorted((repr(i), counter.count(t)) for i, t in rows)
    totals = {}
    for r in got:
        totals[r.doc_id] = totals.get(r.doc_id, 0) + r.n_tokens
    once = {}
    for i, n in want:
        once[i] = once.get(i, 0) + n
    assert {repr(k): v for k, v in totals.items()} == once
    bins = {}
    for r in got:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for pieces in bins.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.bin_offset):
            assert r.bin_offset == end
            end += r.n_tokens
        assert end == pieces[0].bin_tokens <= pieces[0].capacity
    long = sorted((r.first_token, r.n_tokens) for r in got if r.doc_id == 500)
    assert [f for f, _ in long] == list(range(0, long[-1][0] + 1, 256))


def slow_pack(lengths, sizes, opening):
    """Decreasing best fit by plain search: bins as (size opened, contents), the last touched at the end."""
    bins, left = [], sorted(lengths, reverse=True)
    for at, length in enumerate(left):
        rooms = [size - sum(held) - length for size, held in bins]
        if least := [room for room in rooms if room >= 0]:
            chosen = max(i for i, room in enumerate(rooms) if room == min(least))
            size, held = bins.pop(chosen)
            bins.append((size, [*held, length]))
            continue

        def foreseen(room, at=at):
            filled, rest = 0, list(left[at + 1 :])
            for _ in range(op.FORESEEN):
                fit = [x for x in rest if x <= room - filled]
                if not fit:
                    break
                n = min(rest.count(fit[0]), (room - filled) // fit[0])
                filled += n * fit[0]
                rest = [x for x in rest if x != fit[0]] + [fit[0]] * (rest.count(fit[0]) - n)
                rest.sort(reverse=True)
            return filled
        size = min((s for s in sizes if s >= length), key=lambda s: ((s + opening) / (length + foreseen(s - length)), s))
        bins.append((size, [length]))
    return sorted((min(s for s in sizes if s >= sum(held)), sum(held)) for _, held in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=25))
def test_bins_equal_plain_search(lengths):
    _, sizes, held = op.Packer((8, 16, 40)).pack(sorted(lengths, reverse=True))
    assert sum(held) == sum(lengths)
    want = slow_pack(lengths, (8, 16, 40), op.OPENING)
    assert sorted(zip(sizes, held)) == want


def test_packing_does_not_depend_on_the_files(spark, frame):
    rng = random.Random(2)
    rows = [(i % 90 if i % 7 else None, " ".join(rng.choices(["alpha", "beta", "gamma"], k=rng.randrange(60)))) for i in range(200)]
    rows += rows[:40] + [rows[5]] * 30
    made = [sorted(map(repr, op.pack(frame(x).repartition(n), sizes=(64, 128), shard=20).collect())) for x, n in ((rows, 1), (rows[::-1], 5))]
    assert made[0] == made[1]


def test_odd_inputs(odd, no_docs):
    got = op.pack(odd).collect()
    assert {r.doc_id for r in got} == {i for i, _ in ODD}
    assert all((r.bin is None) == (r.n_tokens == 0) for r in got)
    assert sum(r.doc_id == 5 for r in got) == 2
    assert op.pack(no_docs).count() == 0

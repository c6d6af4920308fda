import hashlib
import itertools
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelstate.llm import pii
from tests.llm.conftest import ODD

#: The patterns as the contract words them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def slow(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), list(PATTERNS).index(kind), m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(out)]


@pytest.fixture(scope="module")
def tagger():
    return pii.train()


@settings(max_examples=400, deadline=None)
@given(st.text("ab1 25.@+-()0_\n4é", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == slow(text)


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "+1 (504) 555-2652", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "x.y@z.w.v;300.1.1.1"])
def test_base_examples(text):
    assert pii.base_spans(text) == slow(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "1 " * 150_000, "@" * 100_000, "+1" * 100_000):
        pii.base_spans(text)


def test_the_table_is_learnt(tagger):
    decoder = pii.Decoder(tagger)
    right = 0
    rows = pii.parse()
    for words, labels in rows:
        got = ["O"] * len(words)
        for a, b, kind in decoder.tag([words])[0]:
            got[a:b] = [kind] * (b - a)
        right += got == labels
    assert right / len(rows) > 0.95


def test_marginals_equal_enumeration(tagger):
    rng = np.random.default_rng(0)
    k = 3
    scores, change = rng.normal(size=(4, k)), rng.normal(size=(k, k))
    share, pairs = tagger._marginals(scores, change)
    paths = list(itertools.product(range(k), repeat=4))
    weight = np.exp([sum(scores[i, y] for i, y in enumerate(p)) + sum(change[a, b] for a, b in zip(p, p[1:])) for p in paths])
    weight /= weight.sum()
    for i in range(4):
        for y in range(k):
            assert share[i, y] == pytest.approx(sum(w for w, p in zip(weight, paths) if p[i] == y))
    assert pairs[0, 1] == pytest.approx(sum(w * sum((a, b) == (0, 1) for a, b in zip(p, p[1:])) for w, p in zip(weight, paths)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("at dot example com Mr. John Smith +1 (504) 555-2652 4111 name: the iban DE89 x@y 10.0.0.1 fe80::1".split()), max_size=12), max_size=5))
def test_pruned_decoding_equals_full(texts):
    decoder = pii.Decoder(_tagger())
    scores, starts = decoder.scores(texts)
    full = pii.viterbi([scores[s : s + len(t)] for s, t in zip(starts, texts) if t], decoder.change)
    full = iter(full)
    for text, runs in zip(texts, decoder.tag(texts)):
        got = np.zeros(len(text), int)
        for a, b, kind in runs:
            got[a:b] = pii.LABELS.index(kind)
        if text:
            want = next(full)
            at = scores[int(starts[texts.index(text)]) :]

            def total(labels):
                return sum(at[i, y] for i, y in enumerate(labels)) + sum(decoder.change[a, b] for a, b in zip(labels, labels[1:]))

            assert (got == want).all() or total(got) == pytest.approx(total(want), abs=1e-3)


_CACHE = []


def _tagger():
    if not _CACHE:
        _CACHE.append(pii.train())
    return _CACHE[0]


#: Sentences, names, numbers and forms that the training table doesn't have; [kind|words] marks what is to be found.
OTHER = """
you may send it to [email|susan at pantry dot com] whenever you like
answers go to [email|will at books dot example dot org], not here
questions ? mail [email|otto at garten dot de] first
Contact [email|emma (at) studio (dot) fr] for prints
their address is [email|pierre at cuisine dot fr] and nothing else
please call [phone|(617) 555-0198] before lunch
tel. [phone|030 4455667] is busy
Phone : [phone|646-555-0170]. Nobody answers
mobile [phone|0171 2233445] bleibt aus
host [ip|fe80::aa:bbff:fe11:2233] is gone
client [ip|2001:db8:1:2:3:4:5:6] was refused
his SSN [id|123-45-6789] leaked
passport number [id|H99887766] expired
IBAN [id|NL91 1234 5678 9012 3456] belongs to them
Dr. [name|Walter Lindgren] spoke first
we met Mrs. [name|Osborne] at noon
Frau [name|Ingrid Schuster] bleibt
Name: [name|Yvonne Leclerc] , clerk
Monsieur [name|Armand Petit] est parti
paid with card [card|4111.1111.1111.1111] yesterday
the ship left port at dawn and came back in june
We looked at the map. Then Spring came. Cold Winds blew over the Hills.
it costs 45.90 or 1,300 a month and 20% more in 2022
Yes Yes Yes Yes Yes Yes Yes Yes no
BUY NOW!! AT ONCE!! 100%!! FREE!!
meet me at the dot on the map at nine
version 10.4.3 came on 2023-07-14 at 11:45
room 204 on floor 12 has 3 windows
invoice 20394857 is due and order 11-2044 is not
the file /usr/lib/x.so and https://example.org/a?b=2 are gone
Los niños juegan. Un perro duerme. Las Casas son blancas.
Der Zug kommt. Ein Kind lacht. Die Berge sind hoch.
La mer monte. Un chat dort. Les Rues sont vides.
number nine and name of the game , call of the wild
card games at home with no mail and a phone that rings
the host of the show left the server a tip
part no 4456 , model 33-21 , size 12
"""


def counted(decoder, ruled):
    """Words of the other sentences that are rightly and wrongly tagged, and missed."""
    right = wrong = missed = 0
    for words, labels in pii.parse(OTHER):
        text, found = " ".join(words), set()
        places = [m.span() for m in re.finditer(r"\S+", text)]
        if ruled:
            spans = [s for s in pii.spans([text], decoder)[0][1]]
            found = {(i, k) for i, (a, b) in enumerate(places) for s, e, k in spans if s < b and a < e}
        else:
            found = {(i, k) for a, b, k in decoder.tag([words])[0] for i in range(a, b)}
        want = {(i, x) for i, x in enumerate(labels) if x != "O"}
        right, wrong, missed = right + len(found & want), wrong + len(found - want), missed + len(want - found)
    return right, wrong, missed


def test_other_sentences_are_tagged_before_and_after_the_definitions(tagger):
    decoder = pii.Decoder(tagger)
    for ruled in (False, True):
        right, wrong, missed = counted(decoder, ruled)
        print("definitions" if ruled else "tagger alone", "precision", right / (right + wrong), "recall", right / (right + missed))
        assert right / (right + wrong) > 0.85 and right / (right + missed) > 0.85


def test_the_training_table_holds_nothing_of_the_evaluated_texts(spark, sf_dir):
    texts = " ".join(r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect())
    for words, labels in pii.parse():
        for word, label in zip(words, labels):
            if label != "O" and sum(map(str.isdigit, word)) >= 8:
                assert word not in texts


def test_a_full_table_of_feature_sets_starts_anew(tagger, monkeypatch):
    decoder = pii.Decoder(tagger)
    text = "write to anna at example dot com about it".split()
    want = decoder.tag([text])
    monkeypatch.setattr(pii, "LIMIT", 3)
    assert decoder.tag([text]) == want and decoder.tag([text, text]) == want * 2
    for word in ("walk", "Walk,", "a", "walking.", "Über", "internationally"):
        row = decoder._learn(word)
        assert np.allclose(decoder.table[row], tagger.word_scores(pii.features(word)))


def test_added_spans(tagger):
    decoder = pii.Decoder(tagger)
    cases = {
        "write to anna at example dot com about it": "email",
        "call me at (415) 555-0132 please": "phone",
        "host fe80::1ff:fe23:4567:890a joined": "ip",
        "Mr. John Smith came late": "name",
        "ssn : 078-05-1120 on file": "id",
    }
    for text, kind in cases.items():
        base, every = pii.spans([text], decoder)[0]
        assert not base and kind in {k for _, _, k in every}, text


def test_find_and_redact(frame, odd, no_docs, tagger):
    rows = [(1, "é mail bob@mail.example.com, ip 10.0.0.1 card 4111 1111 1111 1111 and +1 (504) 555-2652."), (2, "clean text of words.")]
    got = {r.doc_id: r for r in pii.find(frame(rows), tagger).collect()}
    base = slow(rows[0][1])
    assert (got[1].n_email, got[1].n_ip, got[1].n_card, got[1].n_phone) == (1, 1, 1, 1)
    assert got[1].base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
    assert set(pii.joined(base).split(",")) <= set(got[1].spans.split(","))
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r for r in pii.redact(frame(rows), tagger).collect()}
    assert clean[1].text == "é mail [EMAIL], ip [IP] card [CARD] and [PHONE]."
    assert clean[1].n_chars == len(clean[1].text) and clean[2].text == rows[1][1]
    assert pii.redact(odd, tagger).columns == odd.columns
    assert sorted((r.doc_id, r.text) for r in pii.redact(odd, tagger).collect() if r.doc_id) != []
    assert sorted(map(repr, ((r.doc_id, r.text) for r in pii.redact(odd, tagger).collect()))) == sorted(map(repr, ODD))
    assert pii.find(no_docs, tagger).count() == 0 and len(pii.find(odd, tagger).collect()) == len(ODD)

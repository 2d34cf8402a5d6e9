"""Segmentation against plain dynamic programming and the library, and exact round trips."""

import random

import pytest
import sentencepiece
from conftest import SF
from llm.data import edge_docs, no_docs

from loomline.llm.pieces import SPACE, Encoder, Stream, decoded, encode_documents, encoded

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def encoder():
    with open(MODEL, "rb") as f:
        return Encoder(f.read())


def plain(v, text):
    """Best score of all segmentations, whole text at once."""
    best = [0.0]
    for n in range(1, len(text) + 1):
        found = [best[i] + v.score[text[i:n]][0] for i in range(max(0, n - v.longest), n) if text[i:n] in v.score]
        if text[n - 1] not in v.score:
            found.append(best[n - 1] + v.unknown)
        best.append(max(found))
    return best[-1]


def score(v, ids):
    by = {i: s for s, i in v.score.values()}
    return sum(by.get(i, 0.0) for i in ids), sum(i not in by for i in ids)


def cases():
    r = random.Random(3)
    out = ["", " ", "  ", "a  b", "\n\n", " a b ", "word" * 40, "é漢𝄞", "x▁y", "a▁ b", "\t tab", "the  the\n the", "trailing ", "\nfirst"]
    out += ["".join(r.choice("ab the é\n \t漢𝄞x1-") for _ in range(r.randint(0, 60))) for _ in range(400)]
    return out


def test_round_trip_and_best_score(encoder):
    texts = cases()
    ids, place = encoder.encode(texts)
    for k, t in enumerate(texts):
        own = ids[place[k] : place[k + 1]].tolist()
        assert encoder.decode(own) == t
        if t and SPACE not in t:
            whole = SPACE + t.replace(" ", SPACE)
            unknown = [c for c in whole if c not in encoder.v.score]
            got, others = score(encoder.v, own)
            assert others == sum(len(c.encode()) for c in unknown)
            assert got + len(unknown) * encoder.v.unknown == pytest.approx(plain(encoder.v, whole), abs=1e-3)
            assert encoder.one(whole) == own  # streamed or in lanes


def test_window_is_bounded_and_ids_come_early(encoder):
    r, s, early = random.Random(5), Stream(encoder.v), 0
    for _ in range(20_000):
        early += len(s.feed(r.choice("etaonrish")))
        assert len(s.text) < 40 * encoder.v.longest
    assert early > 4000 and len(s.finish()) < 400


def test_equals_the_library_where_its_sums_are_exact(encoder, spark):
    """Its unigram search on the same scores; texts without characters outside the vocabulary."""
    with open(MODEL, "rb") as f:
        m = f.read()
    k = m.rfind(b"tok_v0\x18\x02") + 7  # the model type: byte pairs to unigram
    library = sentencepiece.SentencePieceProcessor(model_proto=m[:k] + b"\x01" + m[k + 1 :])
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()
    texts = [x for r in rows for x in r["text"][:300].split("\n") if x and all(c in encoder.v.score or c == " " for c in x)]
    ids, place = encoder.encode(texts)
    for i, t in enumerate(texts):
        own, other = ids[place[i] : place[i + 1]].tolist(), library.nbest_encode_as_ids(t, 2)[0]
        best = score(encoder.v, own)
        assert best[0] >= score(encoder.v, other)[0]
        if best[0] > -1e7:  # its sums are single precision; of equal ones either may choose another
            assert best == score(encoder.v, other)


def test_forgetting_changes_nothing(encoder, monkeypatch):
    import loomline.llm.pieces as module

    texts = cases()
    want = encoder.encode(texts)[0].tolist()
    monkeypatch.setattr(module, "REMEMBERED", 3)
    assert sum((encoder.encode([t])[0].tolist() for t in texts), []) == want


def test_columns_and_edges(spark):
    d = edge_docs(spark)
    got = encode_documents(d, MODEL).collect()
    assert len(got) == d.count() and all(r["round_trip"] and r["n_ids"] == len(r["ids"]) for r in got)
    assert sorted(r["n_ids"] for r in got if r["doc_id"] in (4, 5)) == [0, 0]
    with open(MODEL, "rb") as f:
        model = f.read()
    back = d.where("text IS NOT NULL").select("text", encoded("text", model).alias("e")).select("text", decoded("e.ids", model).alias("t"))
    assert back.where("t <> text").count() == 0
    assert encode_documents(no_docs(spark), MODEL).collect() == []

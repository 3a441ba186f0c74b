"""One address with most of the labels, words beyond what is remembered, tables that stages keep."""

from __future__ import annotations

from pathlib import Path

import pyarrow as pa
import pytest

from shelfmark.llm import common, packing, urls

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_copies_of_one_address_do_not_fill_the_sample(spark):
    hot = [("http://spam.example/buy/now/cheap", True)] * 500
    others = [(f"http://books.example/read/{i}", False) for i in range(12)]
    labelled = spark.createDataFrame(hot + others, "url string, blocked boolean")
    pages = spark.createDataFrame([(1, "http://spam.example/buy/now/cheap"), (2, "http://books.example/read/99")], "id long, url string")
    for most in (13, 20):
        found = {r["id"]: (r["verdict"], r["blocked"]) for r in urls.judge(pages, (), labelled, most_labelled=most).collect()}
        assert found[1][1] > found[2][1] and found[2][0] == urls.ALLOW


def test_an_encoder_that_forgets_gives_the_same_ids(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = pa.array([" ".join(f"word{i * j} café-{i}" for i in range(400)) for j in range(5)] + [None, "", "x <|y", "a\x00b"], pa.string())
    whole = [ids.tolist() for ids in packing.Encoder(path).encode(texts)]
    monkeypatch.setattr(packing, "REMEMBERED_BYTES", 500)
    forgetful = packing.Encoder(path)
    again = [ids.tolist() for text in texts for ids in forgetful.encode(pa.array([text.as_py()], pa.string()))]
    assert whole == again == [forgetful.whole(t.as_py() or "").tolist() for t in texts]


def test_tables_of_a_stage_go_when_the_next_begins(spark):
    place = lambda frame: Path(frame.inputFiles()[0].removeprefix("file:")).parent
    outside = common.keep(spark.range(3), "outside")
    with common.stage_tables():
        inside = common.keep(spark.range(5), "inside")
    assert inside.count() == 5 and outside.count() == 3
    kept = place(inside)
    with common.stage_tables():
        assert not kept.exists() and place(outside).exists()
    assert outside.count() == 3

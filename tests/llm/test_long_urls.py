"""WARC records whose header is longer than any block of the reader."""

import random

import pytest

from thermagrid.llm import warc


@pytest.mark.parametrize("kind", ["plain", "mixed", "escaped"])
def test_pages_with_a_long_url_are_read_back(spark, tmp_path, kind):
    rng = random.Random(9)
    url = {"plain": "http://a/" + "x" * 200_000, "mixed": "http://a/" + "".join(rng.choice("abcdefghij0123456789/?&=") for _ in range(200_000)), "escaped": "http://a/" + "é" * 40_000}[kind]
    pages = [(1, "u", "before"), (2, url, "long"), (3, "u", "after")]
    files = warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}/w")
    for split in (300, 1 << 20):
        got = {r.p: r for r in warc.read(spark, files, split).select(warc.page_id("record_id").alias("p"), "target", "payload").collect()}
        assert {p: bytes(r.payload).decode() for p, r in got.items()} == {p: html for p, _, html in pages}
        assert got[2].target == url.replace("é", "%C3%A9")

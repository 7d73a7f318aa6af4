"""Readers of shards skip what cannot hold their rows, and lose none."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("sedimenta.llm.queries")
from sedimenta.llm import sharding  # noqa: E402


def test_readers_skip_shards_and_lose_no_row(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    manifest = sharding.write_shards(docs, f"{tmp_path}/shards").cache()
    assert manifest.agg(F.sum("n_rows")).first()[0] == docs.count()
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + sharding.ROW_BYTES
    skipped = []
    asked = [dict(lang=r["lang"]) for r in docs.where("lang is not null").select("lang").distinct().collect()]
    asked += [dict(lang="en", source="src0"), dict(source="src3"), dict(sizes=(16, 200)), dict(lang="de", sizes=(5_000, 10**9))]
    for want in asked:
        got = sharding.read_shards(spark, f"{tmp_path}/shards", **want)
        plain = docs
        for c in ("lang", "source"):
            plain = plain.where(F.col(c) == want[c]) if c in want else plain
        plain = plain.where(size.between(*want["sizes"])) if "sizes" in want else plain
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in plain.select("doc_id").collect())
        skipped.append(1 - len(sharding.shards_for(manifest, **want)) / sharding.SHARDS)
    langs, others = skipped[: len(asked) - 4], skipped[len(asked) - 4 :]
    assert sum(langs) / len(langs) >= 0.3 and min(others) >= 0.7, skipped

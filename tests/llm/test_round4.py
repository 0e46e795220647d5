"""Ranked search: what a task holds of the staged index."""

import random

import pyarrow.parquet as pq

from hepark.llm import ranked


def test_index_blocks_are_row_groups(spark, monkeypatch):
    """A reader holds a row group's rows at once: each block of a file is a row group of its own."""
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=12))) for i in range(90)]
    staged, index = ranked.staged, []

    def kept(df, name, **options):
        out = staged(df, name, **options)
        if name == "ranked-index":
            index.append(out)
        return out

    monkeypatch.setattr(ranked, "staged", kept)
    monkeypatch.setattr(ranked, "BLOCK_DOCS", 16)
    found = ranked.search(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1),
                          spark.createDataFrame([(1, "a b"), (2, "c")], "item_id long, text string"), k=5)
    assert found.count() == 10
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index[0].inputFiles()]
    assert sum(m.num_rows for m in files) > len(files)      # some file holds several blocks
    assert all(m.row_group(g).num_rows == 1 for m in files for g in range(m.num_row_groups))

"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from hepark.llm import (bpe, cgk, collision, debruijn, license_rules, linededup, minhash, mixing, ownership, ranked,
                        template, toxicity, trie)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_collision_counting(spark, sf_dir):
    return collision.query(_table(spark, sf_dir, "embeddings"))


def op2_mixing(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents")).drop("copies")


def op3_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_substring_dedup(spark, sf_dir):
    return debruijn.query(_table(spark, sf_dir, "documents"))


def op5_template_removal(spark, sf_dir):
    return template.extract_main_text(_table(spark, sf_dir, "pages"))


def op6_secret_ownership(spark, sf_dir):
    return ownership.query(_table(spark, sf_dir, "documents"))


def op7_minhash_tensored(spark, sf_dir):
    return minhash.query(_table(spark, sf_dir, "documents"))


def op8_license_sentences(spark, sf_dir):
    return license_rules.query(_table(spark, sf_dir, "documents"))


def op9_cgk_decontamination(spark, sf_dir):
    return cgk.contaminations(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_line_dedup(spark, sf_dir):
    return linededup.query(_table(spark, sf_dir, "documents"), words=50)


def op11_truncation_peeling(spark, sf_dir):
    return trie.prefix_trie(_table(spark, sf_dir, "conversations"))


def op12_bpe_backtracking(spark, sf_dir):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.digests(bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path))


def op13_pair_maxscore(spark, sf_dir):
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = [op1_collision_counting, op2_mixing, op3_toxicity, op4_substring_dedup, op5_template_removal,
           op6_secret_ownership, op7_minhash_tensored, op8_license_sentences, op9_cgk_decontamination,
           op10_line_dedup, op11_truncation_peeling, op12_bpe_backtracking,
           op13_pair_maxscore]


def queries():
    return {q.__name__: q for q in QUERIES}


def oracle_sql():
    return {"op2_mixing": mixing.ORACLE, "op8_license_sentences": license_rules.oracle(),
            "op11_truncation_peeling": trie.ORACLE, "op13_pair_maxscore": ranked.ORACLE}

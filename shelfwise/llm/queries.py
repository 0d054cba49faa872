"""The training-data queries and their SQL."""

from __future__ import annotations

from shelfwise.llm import ann, bitslice, common, html_text, lexical, licenses, line_dedup, middle, minhash, packing, pieces, quality, simhash, token_files


def op1_line_dedup(spark, sf_dir):
    return line_dedup.dedup_lines(common.table(spark, sf_dir, "documents"), kept=False)


def op2_quality(spark, sf_dir):
    return quality.classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op3_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(common.table(spark, sf_dir, "documents"))


def op4_kmeans_tree(spark, sf_dir):
    return ann.nearest(common.table(spark, sf_dir, "embeddings"))


def op5_token_files(spark, sf_dir):
    return token_files.encode_to_files(common.table(spark, sf_dir, "documents"))


def op6_html_text(spark, sf_dir):
    return html_text.extract(common.table(spark, sf_dir, "pages"))


def op7_licenses(spark, sf_dir):
    return licenses.scan(common.table(spark, sf_dir, "documents"))


def op8_bit_sliced_top_k(spark, sf_dir):
    return bitslice.top_k(common.table(spark, sf_dir, "embeddings"))


def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(common.table(spark, sf_dir, "documents"))


def op10_pieces(spark, sf_dir):
    return pieces.encode_decode(common.table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark, sf_dir):
    return middle.digests(common.table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return lexical.search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op13_minhash(spark, sf_dir):
    return minhash.near_duplicates(common.table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_quality, op3_best_fit_packing, op4_kmeans_tree, op5_token_files, op6_html_text, op7_licenses, op8_bit_sliced_top_k, op9_simhash, op10_pieces, op11_fill_in_middle, op12_lexical_search, op13_minhash)}
ORACLE_SQL = {"op1_line_dedup": line_dedup.ORACLE, "op8_bit_sliced_top_k": bitslice.ORACLE, "op11_fill_in_middle": middle.ORACLE, "op12_lexical_search": lexical.ORACLE, "op13_minhash": minhash.ORACLE}

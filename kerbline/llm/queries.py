"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from importlib import import_module

#: Query: module; the function in it bears the query's name.
MODULES = {
    "op1_html_text": "html_text",
    "op2_secret_scan": "secret_scan",
    "op3_byte_bpe": "byte_bpe",
    "op4_ngram_join": "ngram_join",
    "op5_quality": "quality",
    "op6_near_vectors": "near_vectors",
    "op7_token_files": "token_files",
    "op8_decontaminate": "decontaminate",
    "op9_chat_format": "chat_format",
    "op10_license_scan": "license_scan",
    "op11_prefix_trie": "prefix_trie",
    "op12_exact_dedup": "exact_dedup",
    "op13_whitening": "whitening",
}
QUERIES = {name: getattr(import_module(f"{__package__}.{module}"), name) for name, module in MODULES.items()}


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline

SQL = {name: import_module(f"{__package__}.{module}").SQL for name, module in MODULES.items() if hasattr(import_module(f"{__package__}.{module}"), "SQL")}

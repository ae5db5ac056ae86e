"""The registered queries of this subpackage, over whole tables with production parameters."""

import importlib

from . import licences, whitening

#: Name of the query, module that holds its function `query(spark, sf_dir)`.
MODULES = {
    "op1_html_template": "html_template",
    "op2_quality": "quality",
    "op3_url_lists": "url_lists",
    "op4_image_copies": "images",
    "op5_pieces": "pieces",
    "op6_jaccard": "jaccard",
    "op7_licences": "licences",
    "op8_substrings": "substring",
    "op9_decontamination": "decontaminate",
    "op10_warc": "warc",
    "op11_whitening": "whitening",
    "op12_secrets": "secrets",
    "op13_conversations": "conversations",
}


def queries() -> dict:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "query") for name, module in MODULES.items()}
    return found | {"licence_base_places": licences.base_places, "whitening_squares": whitening.squares_query}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"{__package__}.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql} | {"licence_base_places": licences.BASE_SQL, "whitening_squares": whitening.SQUARES_SQL}

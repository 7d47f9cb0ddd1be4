"""The queries of this subpackage and the SQL that they are checked against."""

from __future__ import annotations

from . import archives, chat, decontaminate, extract, jaccard, language, neighbours, packing, substring, urls


def queries():
    return {
        "op1_packing": packing.op1_packing,
        "op2_nearest_neighbours": neighbours.op2_nearest_neighbours,
        "op3_language_id": language.op3_language_id,
        "op4_chat_formatting": chat.op4_chat_formatting,
        "op5_warc": archives.op5_warc,
        "op6_jaccard_join": jaccard.op6_jaccard_join,
        "op7_url_filter": urls.op7_url_filter,
        "op8_html_extraction": extract.op8_html_extraction,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_substring_dedup": substring.op10_substring_dedup,
    }


def oracle_sql():
    return {
        "op4_chat_formatting": chat.OP4_SQL,
        "op5_warc": archives.OP5_SQL,
        "op6_jaccard_join": jaccard.OP6_SQL,
        "op7_url_filter": urls.OP7_SQL,
        "op8_html_extraction": extract.OP8_SQL,
        "op9_decontaminate": decontaminate.OP9_SQL,
        "op10_substring_dedup": substring.OP10_SQL,
    }

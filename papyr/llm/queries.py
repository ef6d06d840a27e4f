"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from papyr.llm import (
    bpe,
    decontaminate,
    embed_dedup,
    fm_dedup,
    html_extract,
    impact_index,
    language_id,
    log_bilinear,
    periodic_runs,
    secret_scan,
    simhash,
    suffix_dedup,
    tool_chat,
)

QUERIES = {
    f.__name__: f
    for f in (
        embed_dedup.op1_embedding_dedup,
        language_id.op2_language_id,
        tool_chat.op3_tool_chat,
        tool_chat.tool_links_made,
        bpe.op4_bpe,
        decontaminate.op5_decontamination,
        suffix_dedup.op6_suffix_dedup,
        html_extract.op7_html_extract,
        fm_dedup.op8_fm_dedup,
        simhash.op9_simhash_dedup,
        secret_scan.op10_secret_scan,
        impact_index.op11_impact_search,
        periodic_runs.op12_periodic_runs,
        log_bilinear.op13_log_bilinear,
    )
}
SQL = {
    "op1_embedding_dedup": embed_dedup.SQL,
    "tool_links_made": tool_chat.MADE_SQL,
    "op5_decontamination": decontaminate.SQL,
    "op6_suffix_dedup": suffix_dedup.SQL,
    "op8_fm_dedup": fm_dedup.SQL,
    "op11_impact_search": impact_index.SQL,
}

"""The corpus queries, by name, and their SQL where SQL can state them."""

from __future__ import annotations

from huegrid.llm.alignment import op12_tokenizer_alignment
from huegrid.llm.chat import op5_chat_formatting
from huegrid.llm.decontamination import op9_benchmark_decontamination
from huegrid.llm.html_text import op2_html_extraction
from huegrid.llm.media import op6_media_columns
from huegrid.llm.merkle import OP13_SQL, op13_merkle_manifest
from huegrid.llm.near_join import op8_ngram_jaccard
from huegrid.llm.packing import op1_packing
from huegrid.llm.pitman_yor import op3_lm_scoring
from huegrid.llm.quality_rules import OP11_SQL, op11_quality_rules
from huegrid.llm.secrets import op10_secret_scan
from huegrid.llm.spans import op4_substring_dedup
from huegrid.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_html_extraction": op2_html_extraction,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_media_columns": op6_media_columns,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_secret_scan": op10_secret_scan,
    "op11_quality_rules": op11_quality_rules,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLE_SQL: dict[str, str] = {
    "op11_quality_rules": OP11_SQL,
    "op13_merkle_manifest": OP13_SQL,
    "op5_chat_formatting": r"""
WITH own AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after FROM own
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(4 + 2 + 8 + length(role) + length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', '')))::BIGINT
    AS formatted_chars,
  (bool_and((before, role) IN (('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')))
    AND bool_or(after IS NULL AND role IN ('assistant', 'user'))) AS valid
FROM marked GROUP BY conv_id
""",
}

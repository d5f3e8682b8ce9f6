"""DuckDB SQL for each registered query (the driver's differential check).

Shared fragments reproduce the fixture corpus in plain SQL: documents ranked
inside each language, English paired with every other language by rank.
Whitespace handling uses the same explicit class as the Spark side (RE2 and
Java regex both accept the ``\\x{..}`` form).
"""

from __future__ import annotations

import re

# Written out by hand, not taken from the code under test: labels, task pairs, templates, chat markup and the
# code points that Python's str.isspace() accepts.
LANG_LABELS = {
    "eng": "English", "ben": "Bengali", "guj": "Gujarati", "hin": "Hindi", "kan": "Kannada", "mal": "Malayalam",
    "mar": "Marathi", "ori": "Odia", "pan": "Punjabi", "tam": "Tamil", "tel": "Telugu", "urd": "Urdu",
}
TASK_PAIRS = ["eng_ben", "eng_guj", "eng_hin", "eng_kan", "eng_mal", "eng_mar", "eng_ori", "eng_pan", "eng_tam", "eng_tel", "eng_urd"]
BLOCK_SEP = "\n\n"
FEWSHOT_INSTRUCTION = "Translate the given input document to {tgt_lbl} language. Generate only the translation. Do not generate any other tokens."
EXAMPLE_BLOCK = "{src_lbl}: {src}\n\n{tgt_lbl}: {tgt}"
FINAL_BLOCK = "{src_lbl}: {src}\n\n{tgt_lbl}:"
CHAT_SYSTEM_TEMPLATE = "Translate the text below to {label}."
QUICKSTART_SYSTEM = "You are a professional translator. Translate the user message precisely from {src} to {tgt}, preserving meaning, tone, and any markup."
QUICKSTART_TEMPLATE = "<|begin_of_text|><|system|>\n{system}\n<|user|>\n{text}\n<|assistant|>"
SFT_TEMPLATE = "Translate from {src_lang} to {tgt_lang}:\n\n{src}\n\nTranslation:"
DEFAULT_CHAT_MARKUP = {"open": "<|{role}|>\n", "close": "<|end|>\n", "generation_cue": "<|assistant|>\n"}
SPACES = r"\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NON_WS = f"[{SPACES}]", f"[^{SPACES}]"
STRIP_RE = f"^{WS}+|{WS}+$"


def template_pieces(template: str) -> list[tuple[str, str | None]]:
    """(text, name of the placeholder after it) for each piece of a template."""
    parts = re.split(r"\{(\w+)\}", template)
    return [(parts[i], parts[i + 1] if i + 1 < len(parts) else None) for i in range(0, len(parts), 2)]


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def fill(template: str, **exprs: str) -> str:
    """A template as a SQL concatenation of literals and expressions."""
    parts = []
    for literal, name in template_pieces(template):
        if literal:
            parts.append(q(literal))
        if name is not None:
            parts.append(f"({exprs[name]})")
    return " || ".join(parts)


SEP = q(BLOCK_SEP)


def strip(e: str) -> str:
    return f"regexp_replace({e}, {q(STRIP_RE)}, '', 'g')"


def nwords(e: str) -> str:
    return f"len(regexp_extract_all({e}, {q(NON_WS + '+')}))"


def nows(e: str) -> str:
    return f"regexp_replace({e}, {q(WS + '+')}, '', 'g')"


LABELS_VALUES = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(LANG_LABELS.items()))


def label(e: str) -> str:
    return f"coalesce((SELECT lbl FROM lang_labels WHERE code = {e}), {e})"


CORPUS_CTE = f"""
lang_labels(code, lbl) AS (VALUES {LABELS_VALUES}),
ranked AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ordinal,
         {strip('text')} AS text
  FROM documents
),
parallel AS (
  SELECT CASE WHEN x.ordinal % 5 = 0 THEN 'dev' ELSE 'test' END AS subset,
         'eng_' || x.lang AS pair, x.ordinal, e.text AS src_txt, x.text AS tgt_txt
  FROM ranked e JOIN ranked x ON e.ordinal = x.ordinal
  WHERE e.lang = 'en' AND x.lang <> 'en'
),
dirs AS (
  SELECT subset, pair, ordinal, 'eng' AS src_lang, split_part(pair, '_', 2) AS tgt_lang,
         src_txt AS src, tgt_txt AS tgt FROM parallel
  UNION ALL
  SELECT subset, pair, ordinal, split_part(pair, '_', 2) AS src_lang, 'eng' AS tgt_lang,
         tgt_txt AS src, src_txt AS tgt FROM parallel
),
ldirs AS (
  SELECT d.*, src_lang || '_2_' || tgt_lang AS direction,
         coalesce(ls.lbl, src_lang) AS src_label, coalesce(lt.lbl, tgt_lang) AS tgt_label
  FROM dirs d LEFT JOIN lang_labels ls ON ls.code = d.src_lang LEFT JOIN lang_labels lt ON lt.code = d.tgt_lang
)"""

def instruction(lbl: str = "tgt_label") -> str:
    return fill(FEWSHOT_INSTRUCTION, tgt_lbl=lbl)


def examples_cte(k_max: int, trailing_nl: bool = False) -> str:
    nl = " || chr(10)" if trailing_nl else ""
    return f"""
sel AS (
  SELECT * FROM (
    SELECT pair, ordinal, src_txt, tgt_txt,
           row_number() OVER (PARTITION BY pair ORDER BY ordinal) AS rank
    FROM parallel
    WHERE subset = 'dev' AND {nwords('src_txt')} > 100 AND {nwords('src_txt')} <= 200
  ) WHERE rank <= {k_max}
),
blocks AS (
  SELECT l.pair, l.direction, s.rank,
         {fill(EXAMPLE_BLOCK, src_lbl="l.src_label",
               src="CASE WHEN l.src_lang = 'eng' THEN s.src_txt ELSE s.tgt_txt END",
               tgt_lbl="l.tgt_label",
               tgt="CASE WHEN l.src_lang = 'eng' THEN s.tgt_txt ELSE s.src_txt END")}{nl} AS block
  FROM sel s JOIN (SELECT DISTINCT pair, direction, src_lang, src_label, tgt_label FROM ldirs) l
    ON l.pair = s.pair
)"""


def fewshot_prompt_sql(k: int, trailing_nl: bool = False, parity: bool = False) -> str:
    final = fill(FINAL_BLOCK, src_lbl="t.src_label", src="t.src", tgt_lbl="t.tgt_label")
    return f"""
WITH {CORPUS_CTE},
{examples_cte(k, trailing_nl)},
agg AS (
  SELECT pair, direction, string_agg(block, {SEP} ORDER BY rank) AS ex
  FROM blocks WHERE rank <= {k} GROUP BY pair, direction
)
SELECT t.pair, t.src_lang, t.tgt_lang, t.direction, {k} AS k, t.ordinal,
       {q(FEWSHOT_INSTRUCTION) if parity else instruction('t.tgt_label')} || {SEP}
         || coalesce(a.ex || {SEP}, '') || {final} AS prompt
FROM ldirs t LEFT JOIN agg a ON a.pair = t.pair AND a.direction = t.direction
WHERE t.subset = 'test'
"""


ORACLE: dict[str, str] = {"fewshot_prompt": fewshot_prompt_sql(1)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


DEMO_MODEL_DIR = "Demo-Model_v1"

CORPUS_SCAN_COUNTS = f"""
WITH {CORPUS_CTE}
SELECT subset, pair, split_part(pair, '_', 1) AS src_lang, split_part(pair, '_', 2) AS tgt_lang,
       count(*) AS n_docs, CAST(sum(length(src_txt)) AS BIGINT) AS src_chars, CAST(sum(length(tgt_txt)) AS BIGINT) AS tgt_chars
FROM parallel GROUP BY subset, pair
"""

JSONL_ENCODE_DECODE = f"""
SELECT doc_id, {strip('json_extract_string(to_json([text]), ' + q('$[0]') + ')')} AS strict_text,
       json_extract_string(to_json([text]), '$[0]') AS prompt_text,
       {strip('json_extract_string(to_json([text]), ' + q('$[0]') + ')')} AS score_text
FROM documents
"""

READER_DIALECTS = f"""
SELECT item_id, item_id % 4 AS form,
       CASE WHEN item_id % 4 IN (0, 2) THEN {strip('text')} END AS strict_text,
       item_id % 4 IN (0, 2) AS strict_ok,
       CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN to_json(text)::VARCHAR
            ELSE {strip('text')} END AS prompt_text,
       {strip('text')} AS score_text
FROM benchmark
WHERE regexp_matches(CASE item_id % 4 WHEN 3 THEN text ELSE 'x' END, {q(NON_WS)})
"""

STRIP_AND_BLANK = f"""
WITH l AS (
  SELECT page_id, regexp_split_to_array(html, '\\r\\n|\\r|\\n') AS lines FROM pages
), k AS (
  SELECT page_id, lines,
         list_filter(list_transform(lines, lambda x: {strip('x')}), lambda x: x <> '') AS kept FROM l
)
SELECT page_id, CAST(len(lines) AS INTEGER) AS n_lines, CAST(len(kept) AS INTEGER) AS n_kept,
       CAST(coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) AS BIGINT) AS kept_chars,
       md5(array_to_string(kept, chr(10))) AS kept_md5
FROM k
"""

WORD_BAND = f"""
SELECT doc_id, lang, n_words FROM (
  SELECT doc_id, lang, CAST({nwords(strip('text'))} AS INTEGER) AS n_words FROM documents
) WHERE n_words > 100 AND n_words <= 200
"""

DIRECTIONS_WITH_LABELS = f"""
WITH {CORPUS_CTE},
per AS (SELECT pair, count(*) AS n_docs FROM parallel WHERE subset = 'test' GROUP BY pair),
d AS (
  SELECT pair, n_docs, 'eng' AS src_lang, split_part(pair, '_', 2) AS tgt_lang FROM per
  UNION ALL
  SELECT pair, n_docs, split_part(pair, '_', 2), 'eng' FROM per
)
SELECT pair, src_lang || '_2_' || tgt_lang AS direction, src_lang, tgt_lang,
       {label('src_lang')} AS src_label, {label('tgt_lang')} AS tgt_label, n_docs,
       CASE WHEN src_lang = 'eng' THEN 'src' WHEN tgt_lang = 'eng' THEN 'tgt' END AS eng_side,
       'doc.' || src_lang || '_2_' || tgt_lang || '.1.jsonl' AS prompt_file,
       'doc.' || src_lang || '_2_' || tgt_lang || '.1.pred.jsonl' AS pred_file,
       src_lang AS parsed_src, tgt_lang AS parsed_tgt, 1 AS parsed_k,
       pair || '/{DEMO_MODEL_DIR}/shot1/' || src_lang || '_2_' || tgt_lang || '/doc.' || src_lang || '_2_'
         || tgt_lang || '.1.pred.jsonl' AS run_path
FROM d
"""

ORACLE.update({
    "corpus_scan_counts": CORPUS_SCAN_COUNTS,
    "jsonl_encode_decode": JSONL_ENCODE_DECODE,
    "reader_dialects": READER_DIALECTS,
    "strip_and_blank_filter": STRIP_AND_BLANK,
    "word_band_filter": WORD_BAND,
    "directions_with_labels": DIRECTIONS_WITH_LABELS,
})


def _grams_sql(texts_cte: str) -> str:
    """n-gram counts per (pair, ordinal, n, gram) for two sides ``a``/``b`` of ``texts_cte``
    (columns pair, ordinal, a, b; whitespace already removed)."""
    leads = ["c"]
    for j in range(1, 6):
        leads.append(f"lead(c, {j}) OVER w")
    gcols = ",\n         ".join(" || ".join(leads[:n]) + f" AS g{n}" for n in range(1, 7))
    return f"""
ch AS (
  SELECT pair, ordinal, 'a' AS side, unnest(string_split(a, '')) AS c,
         generate_subscripts(string_split(a, ''), 1) AS i FROM {texts_cte} WHERE length(a) > 0
  UNION ALL
  SELECT pair, ordinal, 'b' AS side, unnest(string_split(b, '')) AS c,
         generate_subscripts(string_split(b, ''), 1) AS i FROM {texts_cte} WHERE length(b) > 0
),
g AS (
  SELECT pair, ordinal, side,
         {gcols}
  FROM ch WINDOW w AS (PARTITION BY pair, ordinal, side ORDER BY i)
),
u AS (UNPIVOT g ON g1, g2, g3, g4, g5, g6 INTO NAME nn VALUE gram),
cnt AS (
  SELECT pair, ordinal, CAST(substr(nn, 2) AS INTEGER) AS n, gram,
         count(*) FILTER (WHERE side = 'a') AS ca, count(*) FILTER (WHERE side = 'b') AS cb
  FROM u GROUP BY ALL
),
per AS (
  SELECT pair, ordinal, n, sum(ca) AS na, sum(cb) AS nb, sum(least(ca, cb)) AS nm FROM cnt GROUP BY ALL
)"""


def _score_sql(tot: str, group: str) -> str:
    """chrF from per-(group, n) sums h, r, m in ``tot``; orders added in sequence."""
    piv = ",\n  ".join(
        f"coalesce(max(CASE WHEN n = {n} THEN h END), 0) AS h{n}, coalesce(max(CASE WHEN n = {n} THEN r END), 0) AS r{n}, "
        f"coalesce(max(CASE WHEN n = {n} THEN m END), 0) AS m{n}" for n in range(1, 7))
    p = " + ".join(f"(CASE WHEN h{n} > 0 AND r{n} > 0 THEN m{n}::DOUBLE / h{n} ELSE 0.0 END)" for n in range(1, 7))
    r = " + ".join(f"(CASE WHEN h{n} > 0 AND r{n} > 0 THEN m{n}::DOUBLE / r{n} ELSE 0.0 END)" for n in range(1, 7))
    e = " + ".join(f"(CASE WHEN h{n} > 0 AND r{n} > 0 THEN 1 ELSE 0 END)" for n in range(1, 7))
    return f"""
wide AS (SELECT {group}, {piv} FROM {tot} GROUP BY {group}),
pre AS (SELECT {group}, ({p}) AS sp, ({r}) AS sr, ({e}) AS eff FROM wide),
fin AS (
  SELECT {group}, CASE WHEN eff = 0 THEN 0.0
                       WHEN sp / eff + sr / eff = 0 THEN 0.0
                       ELSE round(100.0 * 5.0 * (sp / eff) * (sr / eff) / (4.0 * (sp / eff) + (sr / eff)), 4) END AS chrf
  FROM pre
)"""


CHRF_BY_DIRECTION = f"""
WITH {CORPUS_CTE},
seg AS (SELECT pair, ordinal, {nows('src_txt')} AS a, {nows('tgt_txt')} AS b FROM parallel WHERE subset = 'test'),
{_grams_sql('seg')},
dir AS (
  SELECT pair, 'eng_2_' || split_part(pair, '_', 2) AS direction, n,
         CASE WHEN nb > 0 THEN na ELSE 0 END AS h, nb AS r, nm AS m FROM per
  UNION ALL
  SELECT pair, split_part(pair, '_', 2) || '_2_eng' AS direction, n,
         CASE WHEN na > 0 THEN nb ELSE 0 END AS h, na AS r, nm AS m FROM per
),
tot AS (SELECT pair, direction, n, sum(h) AS h, sum(r) AS r, sum(m) AS m FROM dir GROUP BY ALL),
{_score_sql('tot', 'pair, direction')},
cnt_seg AS (SELECT pair, count(*) AS n_segments FROM seg GROUP BY pair),
dirs2 AS (
  SELECT pair, 'eng_2_' || split_part(pair, '_', 2) AS direction, n_segments FROM cnt_seg
  UNION ALL SELECT pair, split_part(pair, '_', 2) || '_2_eng', n_segments FROM cnt_seg
)
SELECT d.pair, d.direction, d.n_segments AS n_ref, d.n_segments AS n_hyp, 'ok' AS status,
       d.n_segments, coalesce(f.chrf, 0.0) AS chrf
FROM dirs2 d LEFT JOIN fin f ON f.pair = d.pair AND f.direction = d.direction
"""

ORACLE["chrf_by_direction"] = CHRF_BY_DIRECTION


def _sweep_sel(k_max: int) -> str:
    return f"""
sel AS (
  SELECT * FROM (
    SELECT pair, ordinal, row_number() OVER (PARTITION BY pair ORDER BY ordinal) AS rank
    FROM parallel
    WHERE subset = 'dev' AND {nwords('src_txt')} > 100 AND {nwords('src_txt')} <= 200
  ) WHERE rank <= {k_max}
),
pdirs AS (
  SELECT DISTINCT pair, 'eng_2_' || split_part(pair, '_', 2) AS direction FROM parallel
  UNION
  SELECT DISTINCT pair, split_part(pair, '_', 2) || '_2_eng' AS direction FROM parallel
),
ks(k) AS (VALUES (0), (1), (3), (8))"""


FEWSHOT_SELECT = f"""
WITH {CORPUS_CTE},
{_sweep_sel(8)}
SELECT d.pair, d.direction, ks.k, CAST(s.rank AS INTEGER) AS rank, s.ordinal
FROM pdirs d JOIN sel s ON s.pair = d.pair JOIN ks ON s.rank <= ks.k
"""

FEWSHOT_SHORTFALL = f"""
WITH {CORPUS_CTE},
{_sweep_sel(8)},
avail AS (SELECT pair, count(*) AS a FROM sel GROUP BY pair)
SELECT d.pair, d.direction, ks.k, least(coalesce(a.a, 0), ks.k) AS n_found,
       least(coalesce(a.a, 0), ks.k) < ks.k AS shortfall
FROM pdirs d CROSS JOIN ks LEFT JOIN avail a ON a.pair = d.pair
"""

BARE_PROMPT = f"""
WITH {CORPUS_CTE}
SELECT pair, src_lang, tgt_lang, direction, 0 AS k, ordinal, src AS prompt FROM ldirs WHERE subset = 'test'
"""

FIRST_N = f"""
WITH {CORPUS_CTE}
SELECT subset, pair, ordinal, CAST(row AS INTEGER) AS row, CAST(length(src_txt) AS INTEGER) AS src_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY subset, pair ORDER BY ordinal) AS row FROM parallel
) WHERE row <= 50
"""


QUICKSTART = f"""
WITH {CORPUS_CTE}
SELECT subset, pair, ordinal,
       {fill(QUICKSTART_TEMPLATE,
             system=fill(QUICKSTART_SYSTEM, src="split_part(pair, '_', 1)", tgt="split_part(pair, '_', 2)"),
             text="src_txt")} AS prompt,
       {strip('src_txt')} AS pred_txt
FROM (SELECT *, row_number() OVER (PARTITION BY subset, pair ORDER BY ordinal) AS row FROM parallel WHERE subset = 'dev')
WHERE row <= 50
"""

_U_OPEN = DEFAULT_CHAT_MARKUP["open"].split("{role}")
_CLOSE = DEFAULT_CHAT_MARKUP["close"]
_CUE = DEFAULT_CHAT_MARKUP["generation_cue"]


def _msg(role: str, content: str) -> str:
    return f"{q(_U_OPEN[0] + role + _U_OPEN[1])} || {content} || {q(_CLOSE)}"


CHAT_RENDER = f"""
WITH fp AS ({fewshot_prompt_sql(1)}),
lab AS (SELECT code, lbl FROM (VALUES {LABELS_VALUES}) t(code, lbl)),
t AS (SELECT fp.*, coalesce(lab.lbl, fp.tgt_lang) AS tgt_label FROM fp LEFT JOIN lab ON lab.code = fp.tgt_lang),
src AS (
  WITH {CORPUS_CTE} SELECT pair, direction, ordinal, src FROM ldirs WHERE subset = 'test'
)
SELECT t.pair, t.direction, t.ordinal,
       {_msg('user', 't.prompt')} || {q(_CUE)} AS user_chat,
       {_msg('system', fill(CHAT_SYSTEM_TEMPLATE, label='t.tgt_label'))} || {_msg('user', 's.src')} || {q(_CUE)} AS system_chat
FROM t JOIN src s ON s.pair = t.pair AND s.direction = t.direction AND s.ordinal = t.ordinal
"""

SAMPLING = f"""
WITH {CORPUS_CTE},
per AS (SELECT DISTINCT pair FROM parallel WHERE subset = 'test'),
d AS (
  SELECT pair, 'eng_2_' || split_part(pair, '_', 2) AS direction FROM per
  UNION ALL SELECT pair, split_part(pair, '_', 2) || '_2_eng' FROM per
),
runs(run, sampling, temperature, top_p, max_new_tokens, batch_size) AS (
  VALUES ('greedy', false, 0.7, 0.9, 8000, 10), ('sampled', true, 0.7, 0.9, 5000, 16)
)
SELECT pair, direction, run, sampling,
       CASE WHEN sampling THEN temperature::DOUBLE ELSE 0.0 END AS eff_temperature,
       CASE WHEN sampling THEN top_p::DOUBLE ELSE 1.0 END AS eff_top_p, max_new_tokens, batch_size
FROM d, runs
"""

STOP_AND_CLEAN = f"""
WITH d AS (SELECT doc_id, {strip('text')} AS gen FROM documents),
p AS (SELECT doc_id, gen, split_part(gen, chr(10), 1) AS prompt FROM d),
o AS (SELECT doc_id, prompt, prompt || split_part(substr(gen, length(prompt) + 2), chr(10), 1) AS g FROM p)
SELECT doc_id, {strip("CASE WHEN prompt = '' THEN g ELSE replace(g, prompt, '') END")} AS pred FROM o
"""

BATCH_INFER = f"""
WITH fp AS ({fewshot_prompt_sql(1)})
SELECT pair, direction, ordinal, {strip('prompt')} AS pred FROM fp
"""

SCRUB = """
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN text || chr(65533) WHEN 2 THEN chr(65533) || '(' || text ELSE text END AS t FROM documents)
SELECT doc_id, CAST(length(t) AS INTEGER) AS n_chars, doc_id % 3 = 0 AS was_valid, md5(t) AS scrubbed_md5 FROM d
"""


def _pad(e: str, n: int) -> str:
    return f"list_resize(list_slice({e}, 1, {n}), {n}, '<pad>')"


SFT_DATASET = f"""
WITH {CORPUS_CTE},
t AS (
  SELECT pair, direction, ordinal,
         regexp_extract_all({fill(SFT_TEMPLATE, src_lang='src_lang', tgt_lang='tgt_lang', src='src')},
                            {q(NON_WS + '+')}) AS pt,
         regexp_extract_all(tgt, {q(NON_WS + '+')}) AS tt
  FROM ldirs
)
SELECT pair, direction, ordinal, 512 AS input_len, CAST(least(len(pt), 512) AS INTEGER) AS n_real,
       CAST(least(len(tt), 512) AS INTEGER) AS n_label_real,
       md5(array_to_string({_pad('pt', 512)}, ' ')) AS input_md5,
       md5(array_to_string({_pad('tt', 512)}, ' ')) AS labels_md5
FROM t
"""

PAIR_STRICT = f"""
WITH {CORPUS_CTE},
c AS (SELECT CASE WHEN ordinal % 5 = 0 THEN 'dev' ELSE 'test' END AS subset, lang, count(*) AS n FROM ranked GROUP BY ALL),
e AS (SELECT subset, n FROM c WHERE lang = 'en')
SELECT c.subset, 'eng_' || c.lang AS pair, coalesce(e.n, 0) AS n_src, c.n AS n_tgt,
       CASE WHEN coalesce(e.n, 0) = c.n THEN 'ok' ELSE 'length mismatch' END AS status
FROM c LEFT JOIN e ON e.subset = c.subset WHERE c.lang <> 'en'
"""

PAIR_TRUNC = f"""
WITH {CORPUS_CTE},
c AS (SELECT lang, count(*) AS n FROM ranked GROUP BY lang),
p AS (SELECT pair, count(*) AS n_pairs FROM parallel GROUP BY pair)
SELECT 'eng_' || c.lang AS pair, (SELECT coalesce(max(n), 0) FROM c WHERE lang = 'en') AS n_src, c.n AS n_tgt,
       coalesce(p.n_pairs, 0) AS n_pairs,
       (SELECT coalesce(max(n), 0) FROM c WHERE lang = 'en') - coalesce(p.n_pairs, 0) AS unmatched_src,
       c.n - coalesce(p.n_pairs, 0) AS unmatched_tgt
FROM c LEFT JOIN p ON p.pair = 'eng_' || c.lang WHERE c.lang <> 'en'
"""

ORACLE.update({
    "fewshot_select_first_k": FEWSHOT_SELECT,
    "fewshot_shortfall": FEWSHOT_SHORTFALL,
    "fewshot_prompt_dialect2": fewshot_prompt_sql(1, trailing_nl=True),
    "bare_prompt": BARE_PROMPT,
    "fewshot_prompt_k3": fewshot_prompt_sql(3),
    "first_n_slice": FIRST_N,
    "quickstart_prompt": QUICKSTART,
    "chat_messages_render": CHAT_RENDER,
    "sampling_params": SAMPLING,
    "stop_and_clean": STOP_AND_CLEAN,
    "batch_infer": BATCH_INFER,
    "scrub_text": SCRUB,
    "sft_dataset": SFT_DATASET,
    "pair_strict_mismatch": PAIR_STRICT,
    "pair_truncating_zip": PAIR_TRUNC,
})


END_TO_END_SQL = f"""
WITH s AS ({CHRF_BY_DIRECTION})
SELECT pair, direction, 1 AS k, n_ref, n_hyp, status, n_segments, chrf,
       CAST(row_number() OVER (ORDER BY chrf DESC, direction ASC) AS INTEGER) AS rank
FROM s
"""

_TASK_VALUES = ", ".join(f"({q(p)})" for p in TASK_PAIRS)

EVAL_COVERAGE = f"""
WITH {CORPUS_CTE},
pairs AS (SELECT DISTINCT pair FROM parallel UNION SELECT pair FROM (VALUES {_TASK_VALUES}) t(pair)),
e AS (
  SELECT split_part(pair, '_', 1) AS src_lang, split_part(pair, '_', 2) AS tgt_lang FROM pairs
  UNION ALL SELECT split_part(pair, '_', 2), split_part(pair, '_', 1) FROM pairs
),
r AS (SELECT DISTINCT direction FROM ldirs WHERE subset = 'test'),
h AS (SELECT DISTINCT direction FROM ldirs WHERE subset = 'test' AND src_lang = 'eng')
SELECT e.src_lang || '_2_' || e.tgt_lang AS direction, e.src_lang, e.tgt_lang,
       'eng_' || CASE WHEN e.src_lang = 'eng' THEN e.tgt_lang ELSE e.src_lang END AS pair,
       CASE WHEN r.direction IS NOT NULL AND h.direction IS NOT NULL THEN 'ok'
            WHEN r.direction IS NOT NULL THEN 'missing_hyp'
            WHEN h.direction IS NOT NULL THEN 'missing_ref'
            ELSE 'missing_ref_and_hyp' END AS status
FROM e LEFT JOIN r ON r.direction = e.src_lang || '_2_' || e.tgt_lang
       LEFT JOIN h ON h.direction = e.src_lang || '_2_' || e.tgt_lang
"""

EVAL_TALLY = f"""
WITH c AS ({EVAL_COVERAGE})
SELECT count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status <> 'ok') AS n_failed,
       count(*) AS n_expected FROM c
"""

SCORE_TOP5 = f"""
WITH s AS ({CHRF_BY_DIRECTION}),
r AS (SELECT *, CAST(row_number() OVER (ORDER BY chrf DESC, direction ASC) AS INTEGER) AS rank FROM s)
SELECT rank, pair, direction, chrf, 'doc.' || direction || '.1.pred.jsonl' AS hyp_file,
       'doc.' || direction || '.1.pred.jsonl' || chr(9) || printf('%.4f', chrf) AS line
FROM r WHERE rank <= 5
"""

ORACLE.update({
    "end_to_end_scores": END_TO_END_SQL,
    "eval_coverage": EVAL_COVERAGE,
    "eval_tally": EVAL_TALLY,
    "score_ranking_top5": SCORE_TOP5,
})


JSONL_INGEST_ZIP = f"""
WITH {CORPUS_CTE}
SELECT subset, pair, ordinal, src_txt, tgt_txt FROM parallel
"""

ORACLE["jsonl_ingest_zip"] = JSONL_INGEST_ZIP


CONVERSATION_TURNS = f"""
WITH c AS (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)
SELECT conv_id, turn, role,
       {q(_U_OPEN[0])} || role || {q(_U_OPEN[1])} || coalesce(text, '') || {q(_CLOSE)}
         || CASE WHEN turn = last THEN {q(_CUE)} ELSE '' END AS rendered
FROM c
"""

ORACLE["conversation_turns_render"] = CONVERSATION_TURNS


SFT_TEXT_PAIRS = """
WITH ranked AS (
  SELECT lang, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ordinal FROM documents
)
SELECT 'eng_' || x.lang AS pair, x.ordinal, md5(e.text) AS src_md5, md5(x.text) AS tgt_md5,
       CAST(length(e.text) AS INTEGER) AS src_chars, CAST(length(x.text) AS INTEGER) AS tgt_chars
FROM ranked e JOIN ranked x ON e.ordinal = x.ordinal AND e.lang = 'en' AND x.lang <> 'en'
"""

ORACLE["sft_text_pairs"] = SFT_TEXT_PAIRS


ORACLE["fewshot_prompt_parity"] = fewshot_prompt_sql(1, parity=True)

# Damaged lines: what each reader must say is written by hand per kind of damage.
ORACLE["reader_rejects"] = """
WITH k(damage, s3, s4, s5) AS (VALUES
  ('good', NULL, NULL, NULL), ('broken', 'not json', 'not json', 'not json'), ('glued', 'not json', 'not json', 'not json'),
  ('trailing', 'not json', 'not json', 'not json'), ('number', 'first element not a string', NULL, NULL),
  ('null', 'first element not a string', 'no text in the json value', 'no text in the json value'),
  ('empty', 'empty array', 'no text in the json value', 'no text in the json value'),
  ('object', 'line must be a string or a single-element list', 'no text in the json value', NULL),
  ('objects', 'not json', 'not json', 'not json'), ('prompt', 'line must be a string or a single-element list', NULL, NULL))
SELECT item_id, damage, s3 AS strict_error, s4 AS prompt_error, s5 AS score_error,
  md5(CASE damage WHEN 'good' THEN trim(text) ELSE '-' END) AS strict_md5,
  md5(CASE damage WHEN 'good' THEN trim(text) WHEN 'number' THEN '1' WHEN 'object' THEN '' WHEN 'prompt' THEN '' ELSE '-' END) AS score_md5,
  damage = 'object' AS paired
FROM benchmark, k
"""

# Two models and two shot counts; the cut and the missing file make those two directions fail.
ORACLE["eval_status"] = f"""
WITH s AS ({CHRF_BY_DIRECTION}),
cut AS (SELECT count(*) AS n FROM (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS o FROM documents WHERE lang = 'de') x,
  (SELECT count(*) AS e FROM documents WHERE lang = 'en') y WHERE o < e AND o < 10 AND o % 5 <> 0),
r AS (
  SELECT m AS model, CAST(k AS INTEGER) AS k, pair, direction, n_ref,
    CASE WHEN m = 'a' AND k = 1 AND direction = 'eng_2_de' THEN n_hyp - (SELECT n FROM cut)
         WHEN m = 'b' AND k = 0 AND direction = 'fr_2_eng' THEN 0 ELSE n_hyp END AS n_hyp, chrf
  FROM s, (VALUES ('a'), ('b')) t(m), (VALUES (0), (1)) u(k)),
t AS (SELECT *, CASE WHEN n_ref = n_hyp THEN 'ok' ELSE 'length mismatch' END AS status FROM r),
g AS (SELECT model, k, direction, CAST(row_number() OVER (PARTITION BY model, k ORDER BY chrf DESC, direction) AS INTEGER) AS rank FROM t WHERE status = 'ok')
SELECT t.model, t.k, pair, t.direction, n_ref, n_hyp, status, CASE WHEN status = 'ok' THEN chrf END AS chrf, rank,
  count(*) FILTER (status = 'ok') OVER (PARTITION BY t.model, t.k) AS run_ok
FROM t LEFT JOIN g ON t.model = g.model AND t.k = g.k AND t.direction = g.direction
"""

ORACLE["end_to_end_fewshot"] = END_TO_END_SQL
ORACLE["prediction_files_scored"] = CHRF_BY_DIRECTION
ORACLE["quickstart_csv"] = f"""
WITH {CORPUS_CTE}
SELECT subset, pair, src_txt, tgt_txt, {strip('src_txt')} AS pred_txt
FROM (SELECT *, row_number() OVER (PARTITION BY subset, pair ORDER BY ordinal) AS row FROM parallel WHERE subset = 'dev')
WHERE row <= 50
"""
ORACLE["coverage_of_run"] = f"""
WITH {CORPUS_CTE},
pairs AS (SELECT DISTINCT pair FROM parallel WHERE subset = 'test' UNION SELECT pair FROM (VALUES {_TASK_VALUES}) t(pair)),
e AS (
  SELECT pair, split_part(pair, '_', 1) AS src_lang, split_part(pair, '_', 2) AS tgt_lang FROM pairs
  UNION ALL SELECT pair, split_part(pair, '_', 2), split_part(pair, '_', 1) FROM pairs
),
there AS (SELECT DISTINCT pair FROM parallel WHERE subset = 'test')
SELECT src_lang || '_2_' || tgt_lang AS direction, src_lang, tgt_lang, pair,
       CASE WHEN pair NOT IN (SELECT pair FROM there) THEN 'missing_ref_and_hyp'
            WHEN pair = 'eng_de' THEN 'missing_ref'
            WHEN src_lang = 'fr' THEN 'missing_hyp' ELSE 'ok' END AS status
FROM e
"""
ORACLE["run_ledger"] = f"""
WITH {CORPUS_CTE},
r AS (
  SELECT pair, src_lang || '_2_' || tgt_lang AS direction, ordinal, count(*) OVER () AS total,
         row_number() OVER (ORDER BY pair, src_lang || '_2_' || tgt_lang, ordinal) - 1 AS i
  FROM dirs WHERE subset = 'test'
),
u AS (SELECT *, i // least(10000, greatest(1, CAST(ceil(total / 4.0) AS BIGINT))) AS unit FROM r)
SELECT unit, 'Demo-Model:v1' AS model, '0,1' AS ks,
       first(pair || '/' || direction || '/' || ordinal ORDER BY i) AS first_key,
       last(pair || '/' || direction || '/' || ordinal ORDER BY i) AS last_key,
       count(*) AS n_rows, 2 * count(*) AS n_predictions
FROM u GROUP BY unit
"""
ORACLE["paired_rejects"] = f"""
WITH {CORPUS_CTE},
p AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY ordinal) AS line, ordinal AS o FROM parallel)
SELECT pair, line, CASE WHEN o % 7 = 3 OR o % 11 = 4 OR o % 13 = 5 THEN 'source not a {{text}} object' ELSE 'target not a {{text}} object' END AS reason
FROM p WHERE o % 7 IN (3, 1) OR o % 11 = 4 OR o % 13 IN (5, 2)
"""
ORACLE["user_tokenizer"] = """
WITH t AS (SELECT doc_id, regexp_extract_all(text, '(?s).{1,4}') AS t FROM documents)
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, '|')) AS tokens_md5 FROM t
"""

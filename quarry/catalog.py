"""The queries over the test tables, by name, and their SQL.

Adapters: the corpus is ``documents`` (doc_id is its order); question-answer pairs
are adjacent user and assistant turns of ``conversations``, whose conv_id is the
document they belong to; finished ids are those in ``labels``; folders are the
parts of ``pages.url``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .functions.chunks import select_context, split_chunks
from .functions.doctype import document_type
from .operators import evaluate, profile, qa, sft, split, validate

#: Type words that occur in the Latin test texts; the default dictionary is Russian.
LATIN_TYPES = (("Conjunction", "and"), ("Article", r"the(?!\w)"), ("Preposition", r"de\w*|with"), ("Plural", r"les\s+\w"), ("German", r"und|der"), ("Spanish", "ci[oó]n"))


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, pos, instruction, output): user turns that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("output"))
    return rows.where("role = 'user' and next_role = 'assistant'").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("pos"), F.col("text").alias("instruction"), "output")


def _joined(c) -> object:
    return F.array_join(F.array_sort(c), " ")


def clean_documents(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("text"))


def content_ids(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("document_id"))


def first_documents(spark, d):
    return qa.first_documents(_t(spark, d, "documents").select("doc_id", "lang"), "doc_id", 50)


def corpus_profile(spark, d):
    return profile.corpus_profile(_t(spark, d, "documents").select("text"))


def length_percentiles(spark, d):
    return profile.length_percentiles(_t(spark, d, "documents").select("text"))


def frequency_by_lang(spark, d):
    return profile.frequency(_t(spark, d, "documents"), "lang")


def frequency_by_source(spark, d):
    return profile.frequency(_t(spark, d, "documents"), "source")


def suspicious_documents(spark, d):
    return profile.suspicious(_t(spark, d, "documents"), "doc_id").select("doc_id", "lang", "source", "length")


def exact_duplicates(spark, d):
    return profile.exact_duplicates(_t(spark, d, "documents"))


def normalized_questions(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.normalize_question(F.col("text")).alias("text"))


def normalized_answers(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.normalize_answer(F.col("text")).alias("text"))


def document_stems(spark, d):
    return _t(spark, d, "documents").select("doc_id", _joined(tx.stems(F.col("text"))).alias("stems"))


def document_tokens(spark, d):
    return _t(spark, d, "documents").select("doc_id", _joined(tx.token_set(F.col("text"))).alias("tokens"))


def grounding_scores(spark, d):
    g = tx.grounding(tx.stems(F.col("output")), tx.stems(F.col("instruction")))
    rows = _pairs(spark, d).withColumn("score", g)
    return rows.select("document_id", "pos", "score", tx.rounded(F.col("score"), 3).alias("grounding"), (F.col("score") >= qa.MIN_GROUNDING).alias("grounded"))


def chunk_lengths(spark, d):
    chunks = split_chunks(F.col("text"), 500)
    rows = _t(spark, d, "documents").select("doc_id", F.posexplode(chunks).alias("no", "chunk"))
    return rows.select("doc_id", F.col("no").cast("long"), F.length("chunk").cast("long").alias("n"), F.md5(F.col("chunk").cast("binary")).alias("md5"))


def selected_contexts(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text")
    docs = docs.withColumns({"norm": tx.normalize_question(F.col("text")), "chunks": split_chunks(F.col("text"), 600)})
    rows = _pairs(spark, d).join(docs, "document_id")
    context = select_context(F.col("text"), F.lit(""), F.col("instruction"), F.col("output"), 600, F.col("norm"), F.col("chunks"))
    return rows.select("document_id", "pos", context.alias("context"))


def detected_types(spark, d):
    return _t(spark, d, "documents").select("doc_id", document_type(F.col("text"), None, LATIN_TYPES).alias("document_type"))


def folder_types(spark, d):
    types = (("English", "en"), ("German", "de"), ("Blog", "blog"), ("Web", "www"))
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return _t(spark, d, "pages").select("page_id", document_type(F.lit(""), path, types).alias("document_type"))


def _judged(spark, d):
    """Question-answer pairs twice, so that duplicates occur, grounded against question and half of the answer."""
    rows = _pairs(spark, d)
    rows = rows.unionAll(rows.select("document_id", F.col("pos") + 1000, F.concat(F.lit("- "), "instruction", F.lit(" ?")), F.when(F.col("pos") % 4 == 0, "").otherwise(F.col("output"))))
    half = F.substring("output", F.lit(1), F.floor(F.length("output") * F.when(F.col("pos") % 3 == 0, F.lit(0.8)).otherwise(F.lit(0.4))).cast("int"))
    rows = rows.withColumn("score", tx.grounding(tx.stems(F.col("output")), tx.stems(half)))
    return qa.judged(rows, ("document_id",))


def qa_status(spark, d):
    return _judged(spark, d).select("document_id", "pos", "score", "status")


def qa_counters(spark, d):
    return qa.counters(_judged(spark, d))


def resume_remaining(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    return qa.remaining(docs, _t(spark, d, "labels").select(F.col("doc_id").alias("document_id")))


def _records(spark, d):
    docs = _t(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("input"), F.col("lang").alias("document_type"))
    return _pairs(spark, d).join(docs, "document_id")


def validated_records(spark, d):
    rows = _pairs(spark, d).select(
        F.when(F.col("pos") % 7 != 6, F.col("document_id").cast("string")).alias("document_id"),
        F.when(F.col("pos") % 3 == 0, "").otherwise(F.lit(" chat ")).alias("document_type"),
        F.when(F.col("document_id") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "instruction")).alias("instruction"),
        F.lit(None).cast("string").alias("input"),
        F.col("output"),
        F.col("document_id").alias("conv"), "pos",
    )
    return validate.typed_records(rows).select("conv", "pos", "document_id", "document_type", "instruction", "input", "output", "error")


def split_assignment(spark, d):
    return split.assigned(split.ranked_ids(_t(spark, d, "documents"), key="doc_id"))


def split_summary(spark, d):
    rows = _pairs(spark, d)
    return split.summary(split.split_records(rows))


def split_leaks(spark, d):
    return split.leaks(split.split_records(_pairs(spark, d)))


def truncated_contexts(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.truncate_context(F.col("text"), 300).alias("context"))


def sft_messages(spark, d):
    rows = sft.formatted(_records(spark, d).withColumn("document_id", F.concat_ws(":", "document_id", "pos")))
    m = lambda c, i, f: F.col(c)[i][f]
    return rows.select("document_id", "document_type", m("prompt", 0, "content").alias("system"), m("prompt", 1, "role").alias("user_role"), m("prompt", 1, "content").alias("user"), m("completion", 0, "content").alias("assistant"))


def budget_report(spark, d):
    return sft.budget_report(sft.formatted(_records(spark, d)), most=256)


def _predictions(spark, d):
    return _pairs(spark, d).select("document_id", "pos", F.col("output").alias("reference"), F.when(F.col("pos") % 3 == 0, F.concat("output", F.lit("!?"))).otherwise(F.col("instruction")).alias("prediction"))


def evaluated_predictions(spark, d):
    return evaluate.evaluated(_predictions(spark, d)).select("document_id", "pos", "exact_match", "token_recall")


def evaluation_summary(spark, d):
    s = evaluate.evaluation_summary(evaluate.evaluated(_predictions(spark, d)))
    return s.select("examples", tx.rounded(F.col("exact_match"), 6).alias("exact_match"), tx.rounded(F.col("mean_token_recall"), 6).alias("mean_token_recall"), "warning")


def dataset_sanity(spark, d):
    s = evaluate.dataset_sanity(_records(spark, d), _t(spark, d, "labels").select(F.col("doc_id").alias("document_id")))
    r = lambda c: tx.rounded(F.col(c), 6).alias(c)
    return s.select("examples", "empty_instructions", "empty_outputs", "missing_sources", r("duplicate_question_rate"), r("mean_input_length"), r("mean_output_length"))


def type_distribution(spark, d):
    return evaluate.type_distribution(_records(spark, d))


_ALL = (
    clean_documents, content_ids, first_documents, corpus_profile, length_percentiles, frequency_by_lang, frequency_by_source,
    suspicious_documents, exact_duplicates, normalized_questions, normalized_answers, document_stems, document_tokens,
    grounding_scores, chunk_lengths, selected_contexts, detected_types, folder_types, qa_status, qa_counters, resume_remaining,
    validated_records, split_assignment, split_summary, split_leaks, truncated_contexts, sft_messages, budget_report,
    evaluated_predictions, evaluation_summary, dataset_sanity, type_distribution,
)

QUERIES = {f.__name__: f for f in _ALL}


# --- the same in SQL ---------------------------------------------------------

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WORD = r"\p{L}\p{N}_"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _norm_q(x: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(replace(lower(coalesce({x}, '')), 'ё', 'е'), '[^{_WORD}{_WS}]', ' ', 'g'), '[{_WS}]+', ' ', 'g')")


def _norm_a(x: str) -> str:
    return f"regexp_replace(regexp_replace({_strip(f'lower({x})')}, '[{_WS}]+', ' ', 'g'), '[^{_WORD}{_WS}]', '', 'g')"


def _stems(x: str) -> str:
    return f"list_distinct(list_transform(list_filter(string_split({_norm_q(x)}, ' '), lambda w: length(w) >= 4), lambda w: w[1:5]))"


def _tokens(x: str) -> str:
    return f"list_distinct(list_filter(string_split({_norm_a(x)}, ' '), lambda w: w <> ''))"


def _grounding(a: str, c: str) -> str:
    return f"CASE WHEN len({a}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {c}))::DOUBLE / len({a}) END"


def _truncate(x: str, n: int) -> str:
    return f"""(SELECT CASE WHEN length(s) <= {n} THEN s ELSE regexp_replace(CASE WHEN sp > {0.8 * n} THEN s[1:sp] ELSE s[1:{n}] END, '[{_WS}]+$', '') || ' …' END
      FROM (SELECT s, CASE WHEN instr(s[1:{n}], ' ') > 0 THEN length(s[1:{n}]) - instr(reverse(s[1:{n}]), ' ') ELSE -1 END AS sp FROM (SELECT {_strip(f"coalesce({x}, '')")} AS s)))"""


def _chunks(x: str, n: int) -> str:
    paragraphs = f"list_filter(list_transform(regexp_split_to_array({x}, '\\n[{_WS}]*\\n|\\n'), lambda p: {_strip('p')}), lambda p: p <> '')"
    pieces = f"flatten(list_transform({paragraphs}, lambda p: list_transform(range(1, length(p) + 1, {n}), lambda i: p[i:i + {n - 1}])))"
    step = f"""CASE WHEN a.open = '' THEN {{'done': a.done, 'open': p.open}}
      WHEN length(a.open) + 1 + length(p.open) <= {n} THEN {{'done': a.done, 'open': a.open || chr(10) || p.open}}
      ELSE {{'done': list_append(a.done, a.open), 'open': p.open}} END"""
    start = "{'done': []::VARCHAR[], 'open': ''}"
    items = f"list_transform({pieces}, lambda q: {{'done': []::VARCHAR[], 'open': q}})"
    return f"(SELECT CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END FROM (SELECT list_reduce({items}, lambda a, p: {step}, {start}) AS r))"


_PAIRS_SQL = """pairs AS (
  SELECT conv_id AS document_id, turn AS pos, text AS instruction, output FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS output FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""

_RECORDS_SQL = f"{_PAIRS_SQL}, records AS (SELECT p.*, d.text AS input, d.lang AS document_type FROM pairs p JOIN documents d ON d.doc_id = p.document_id)"


def _at(head: str, pattern: str) -> str:
    """Start of a pattern that no word character precedes, or null."""
    p = pattern.replace(r"(?!\w)", f"(?:[^{_WORD}]|$)").replace(r"\w", f"[{_WORD}]").replace(r"\s", f"[{_WS}]")
    rx = f"(?s)^((?:.*?[^{_WORD}])??)(?:{p})"
    return f"CASE WHEN regexp_matches({head}, '{rx}') THEN length(regexp_extract({head}, '{rx}', 1)) + 1 END"


_TYPES_SQL = ", ".join(f"{{'at': {_at('head', p)}, 'no': {i}, 'name': '{name}'}}" for i, (name, p) in enumerate(LATIN_TYPES))

_JUDGED_SQL = f"""{_PAIRS_SQL}, both_ AS (
  SELECT document_id, pos, instruction, output FROM pairs
  UNION ALL SELECT document_id, pos + 1000, '- ' || instruction || ' ?', CASE WHEN pos % 4 = 0 THEN '' ELSE output END FROM pairs),
st AS (SELECT *, {_stems('output')} AS a, {_stems("output[1:floor(length(output) * CASE WHEN pos % 3 = 0 THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END)::BIGINT]")} AS c, {_norm_q('instruction')} AS k,
  {_strip('instruction')} = '' OR {_strip('output')} = '' AS empty FROM both_),
sc AS (SELECT *, {_grounding('a', 'c')} AS score FROM st),
j AS (SELECT *, min(CASE WHEN NOT empty AND score >= 0.6::DOUBLE THEN pos END) OVER (PARTITION BY document_id, k) AS first_ok FROM sc),
judged AS (SELECT document_id, pos, score, CASE WHEN empty THEN 'empty' WHEN pos > first_ok THEN 'duplicate' WHEN score < 0.6::DOUBLE THEN 'ungrounded' ELSE 'accepted' END AS status FROM j)"""


def _split_sql(ids: str) -> str:
    return f"""ranked AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT {ids})),
assigned AS (SELECT id, CASE WHEN r <= floor(n * 0.9::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ranked)"""


_PROFILE_SQL = """l AS (SELECT length(coalesce(text, ''))::BIGINT AS n, {blank} AS blank FROM documents),
o AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c FROM l)""".format(blank=_strip("coalesce(text, '')") + " = ''")


def _nearest(p: float) -> str:
    return f"(SELECT n FROM o WHERE i = round_even((c - 1) * {p}::DOUBLE, 0)::BIGINT)"


_PRED_SQL = f"""{_PAIRS_SQL}, pr AS (SELECT document_id, pos, output AS reference, CASE WHEN pos % 3 = 0 THEN output || '!?' ELSE instruction END AS prediction FROM pairs),
t AS (SELECT *, {_tokens('prediction')} AS p, {_tokens('reference')} AS r FROM pr),
ev AS (SELECT document_id, pos, {_norm_a('prediction')} = {_norm_a('reference')} AS exact_match, CASE WHEN len(r) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(p, r))::DOUBLE / len(r) END AS token_recall FROM t)"""

SQL = {
    "clean_documents": f"SELECT doc_id, {_strip(r'''regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')''')} AS text FROM documents",
    "content_ids": "SELECT doc_id, sha256(text) AS document_id FROM documents",
    "first_documents": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50",
    "corpus_profile": f"""WITH {_PROFILE_SQL} SELECT count(*) AS total_documents, count_if(blank)::BIGINT AS empty_documents, count_if(n < 100)::BIGINT AS short_documents,
      min(n) AS min_length, max(n) AS max_length, printf('%.1f', avg(n))::DOUBLE AS mean_length, 100 AS short_threshold,
      printf('%.4f', count_if(blank)::DOUBLE / count(*))::DOUBLE AS empty_rate, printf('%.4f', count_if(n < 100)::DOUBLE / count(*))::DOUBLE AS short_rate,
      {_nearest(0.5)} AS p50_length, {_nearest(0.9)} AS p90_length, {_nearest(0.99)} AS p99_length FROM l""",
    "length_percentiles": f"WITH {_PROFILE_SQL} SELECT 0.5::DOUBLE AS share, {_nearest(0.5)} AS value UNION ALL SELECT 0.9, {_nearest(0.9)} UNION ALL SELECT 0.99, {_nearest(0.99)}",
    "frequency_by_lang": "SELECT lang, count(*) AS documents FROM documents GROUP BY lang",
    "frequency_by_source": "SELECT source, count(*) AS documents FROM documents GROUP BY source",
    "suspicious_documents": "SELECT doc_id, lang, source, length(text)::BIGINT AS length FROM documents WHERE length(text) < 100 ORDER BY doc_id LIMIT 20",
    "exact_duplicates": "SELECT sha256(text) AS content_id, count(*) AS documents FROM documents GROUP BY 1 HAVING count(*) > 1",
    "normalized_questions": f"SELECT doc_id, {_norm_q('text')} AS text FROM documents",
    "normalized_answers": f"SELECT doc_id, {_norm_a('text')} AS text FROM documents",
    "document_stems": f"SELECT doc_id, array_to_string(list_sort({_stems('text')}), ' ') AS stems FROM documents",
    "document_tokens": f"SELECT doc_id, array_to_string(list_sort({_tokens('text')}), ' ') AS tokens FROM documents",
    "grounding_scores": f"WITH {_PAIRS_SQL}, s AS (SELECT document_id, pos, {_stems('output')} AS a, {_stems('instruction')} AS c FROM pairs), g AS (SELECT document_id, pos, {_grounding('a', 'c')} AS score FROM s) SELECT document_id, pos, score, printf('%.3f', score)::DOUBLE AS grounding, score >= 0.6::DOUBLE AS grounded FROM g",
    "chunk_lengths": f"WITH c AS (SELECT doc_id, {_chunks('text', 500)} AS c FROM documents), u AS (SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS no FROM c) SELECT doc_id, no::BIGINT AS no, length(chunk)::BIGINT AS n, md5(chunk) AS md5 FROM u",
    "selected_contexts": f"""WITH {_PAIRS_SQL}, d AS (SELECT doc_id, text, {_chunks('text', 600)} AS c FROM documents WHERE doc_id IN (SELECT document_id FROM pairs)),
      j AS (SELECT p.document_id, p.pos, d.text, d.c, list_concat({_stems('p.instruction')}, {_stems('p.output')}) AS t FROM pairs p JOIN d ON d.doc_id = p.document_id),
      u AS (SELECT document_id, pos, text, t, unnest(c) AS chunk, generate_subscripts(c, 1) AS no FROM j),
      s AS (SELECT *, len(list_intersect(list_distinct(t), {_stems('chunk')})) AS score FROM u),
      r AS (SELECT *, row_number() OVER (PARTITION BY document_id, pos ORDER BY score DESC, no) AS rn FROM s)
      SELECT document_id, pos, CASE WHEN length(text) <= 600 THEN text ELSE chunk END AS context FROM r WHERE rn = 1""",
    "detected_types": f"""WITH h AS (SELECT doc_id, lower(coalesce(text, '')[1:600]) AS head FROM documents)
      SELECT doc_id, coalesce(list_min(list_filter([{_TYPES_SQL}], lambda x: x.at IS NOT NULL)).name, 'unknown') AS document_type FROM h""",
    "folder_types": """WITH p AS (SELECT page_id, list_filter(string_split(regexp_replace(url, '^[a-z]+://', ''), '/'), lambda x: x <> '' AND x <> '.') AS p FROM pages)
      SELECT page_id, coalesce(list_filter(list_transform(list_reverse(p[1:len(p) - 1]), lambda f: CASE WHEN starts_with(lower(f), 'en') THEN 'English' WHEN starts_with(lower(f), 'de') THEN 'German' WHEN starts_with(lower(f), 'blog') THEN 'Blog' WHEN starts_with(lower(f), 'www') THEN 'Web' END), lambda x: x IS NOT NULL)[1], 'unknown') AS document_type FROM p""",
    "qa_status": f"WITH {_JUDGED_SQL} SELECT * FROM judged",
    "qa_counters": f"WITH {_JUDGED_SQL} SELECT count_if(status = 'accepted')::BIGINT AS examples, count_if(status = 'empty')::BIGINT AS empty, count_if(status = 'duplicate')::BIGINT AS duplicates, count_if(status = 'ungrounded')::BIGINT AS ungrounded FROM judged",
    "resume_remaining": "SELECT doc_id AS document_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "validated_records": f"""WITH {_PAIRS_SQL}, v AS (SELECT document_id AS conv, pos, CASE WHEN pos % 7 <> 6 THEN document_id::VARCHAR END AS document_id, CASE WHEN pos % 3 = 0 THEN '' ELSE ' chat ' END AS document_type,
      CASE WHEN document_id % 5 = 0 THEN '  ' ELSE ' ' || instruction END AS instruction, output FROM pairs)
      SELECT conv, pos, {_strip('document_id')} AS document_id, CASE WHEN document_type = '' THEN 'unknown' ELSE {_strip('document_type')} END AS document_type, {_strip('instruction')} AS instruction, '' AS input, {_strip('output')} AS output,
      CASE WHEN {_strip("coalesce(document_id, '')")} = '' THEN '''document_id'' must be a non-empty string' WHEN {_strip('instruction')} = '' THEN '''instruction'' must be a non-empty string' WHEN {_strip('output')} = '' THEN '''output'' must be a non-empty string' END AS error FROM v""",
    "split_assignment": f"WITH {_split_sql('doc_id::VARCHAR AS id FROM documents')} SELECT id AS doc_id, split FROM assigned",
    "split_summary": f"WITH {_PAIRS_SQL}, {_split_sql('document_id::VARCHAR AS id FROM pairs')}, s AS (SELECT a.id, a.split, count(*) AS c FROM pairs p JOIN assigned a ON a.id = p.document_id::VARCHAR GROUP BY ALL) SELECT count(*) AS documents, sum(c)::BIGINT AS examples, "
    + ", ".join(f"coalesce(sum(c) FILTER (split = '{s}'), 0)::BIGINT AS {s}_examples, count_if(split = '{s}')::BIGINT AS {s}_documents" for s in ("train", "validation", "test"))
    + " FROM s",
    "split_leaks": f"WITH {_PAIRS_SQL}, {_split_sql('document_id::VARCHAR AS id FROM pairs')} SELECT p.document_id, count(DISTINCT a.split) AS splits FROM pairs p JOIN assigned a ON a.id = p.document_id::VARCHAR GROUP BY p.document_id HAVING count(DISTINCT a.split) > 1",
    "truncated_contexts": f"SELECT doc_id, {_truncate('text', 300)} AS context FROM documents",
    "sft_messages": f"""WITH {_RECORDS_SQL}, c AS (SELECT *, {_truncate('input', 1800)} AS ctx FROM records)
      SELECT document_id::VARCHAR || ':' || pos::VARCHAR AS document_id, document_type, '{sft.SYSTEM_PROMPT}' AS system, 'user' AS user_role,
      CASE WHEN ctx = '' THEN instruction ELSE instruction || '{sft.CONTEXT_HEADING}' || ctx END AS "user", output AS assistant FROM c""",
    "budget_report": f"""WITH {_RECORDS_SQL}, c AS (SELECT *, {_truncate('input', 1800)} AS ctx FROM records), t AS (
      SELECT '{sft.SYSTEM_PROMPT} ' || CASE WHEN ctx = '' THEN instruction ELSE instruction || '{sft.CONTEXT_HEADING}' || ctx END || ' ' || output AS s FROM c),
      n AS (SELECT len(list_filter(regexp_split_to_array(s, '[{_WS}]+'), lambda w: w <> '')) AS n FROM t)
      SELECT count(*) AS before, count_if(n <= 256)::BIGINT AS kept, count_if(n > 256)::BIGINT AS dropped FROM n""",
    "evaluated_predictions": f"WITH {_PRED_SQL} SELECT * FROM ev",
    "evaluation_summary": f"WITH {_PRED_SQL} SELECT count(*) AS examples, printf('%.6f', avg(exact_match::INT))::DOUBLE AS exact_match, printf('%.6f', avg(token_recall))::DOUBLE AS mean_token_recall, '{evaluate.WARNING}' AS warning FROM ev",
    "dataset_sanity": f"""WITH {_RECORDS_SQL} SELECT count(*) AS examples, count_if({_strip('instruction')} = '')::BIGINT AS empty_instructions, count_if({_strip('output')} = '')::BIGINT AS empty_outputs,
      count_if(document_id NOT IN (SELECT doc_id FROM labels))::BIGINT AS missing_sources, printf('%.6f', 1 - count(DISTINCT {_norm_q('instruction')})::DOUBLE / count(*))::DOUBLE AS duplicate_question_rate,
      printf('%.6f', avg(length(input)))::DOUBLE AS mean_input_length, printf('%.6f', avg(length(output)))::DOUBLE AS mean_output_length FROM records""",
    "type_distribution": f"WITH {_RECORDS_SQL} SELECT document_type, count(*) AS examples FROM records GROUP BY document_type",
}

"""Queries over sources, sinks and injected models, by name, and their SQL.

Their files are made from the tables, so that SQL over the tables says what must come back.
"""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import fixtures
from .catalog import _PAIRS_SQL, _RECORDS_SQL, LATIN_TYPES, _at, _grounding, _norm_a, _pairs, _records, _split_sql, _stems, _strip, _t, _tokens
from .functions.doctype import DOCUMENT_TYPES, document_type
from .operators import evaluate, profile, qa, sft, split, validate
from .sources import files, jsonl

#: Headings for the type dictionary; some only begin like a type, some name a second one later.
HEADINGS = (
    "ПРИКАЗ № 5", "Служебная записка", "докладные записки отдела", "Пояснительная  записка к приказу", "Должностной инструкции", "о распоряжении", "Постановление", "Решения", "Положение об отделе",
    "инструкция", "Регламент", "договору №7", "Соглашение", "протокола", "акт", "актив", "Акта приёма", "Отчет", "отчёт по справке", "Справка", "Заявления", "доверенность", "письмо", "без типа", "предприказ",
)


def _documents(spark, d):
    return _t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.lit(None).cast("string").alias("document_type"), F.col("lang").alias("instruction"), F.col("source").alias("input"), F.col("text").alias("output"))


def jsonl_overwrite(spark, d):
    """Records written over others and read back."""
    path, rows = fixtures.folder(spark), _documents(spark, d)
    jsonl.write_jsonl(rows.limit(1), path)
    jsonl.write_jsonl(rows, path)
    return jsonl.read_jsonl(spark, path, jsonl.RECORD)


def jsonl_append(spark, d):
    path, rows = fixtures.folder(spark), _documents(spark, d)
    odd = F.col("document_id").cast("long") % 2 == 1
    jsonl.write_jsonl(rows.where(odd), path)
    jsonl.write_jsonl(rows.where(~odd), path, append=True)
    return jsonl.read_jsonl(spark, path, jsonl.RECORD).groupBy("input").agg(F.count("*").alias("n"), F.sum(F.length("output")).alias("characters"))


def training_records(spark, d):
    path = fixtures.folder(spark)
    jsonl.write_jsonl(sft.formatted(_records(spark, d)), path)
    rows = jsonl.read_training(spark, path)
    return rows.select(F.md5(F.to_json("prompt").cast("binary")).isNotNull().alias("parsed"), F.size("prompt").alias("messages"), F.element_at("completion", 1)["content"].alias("answer"))


def profile_report(spark, d):
    """A report as it is written, read back by its fields."""
    path = fixtures.folder(spark)
    report = json.loads(jsonl.write_report(profile.corpus_profile(_t(spark, d, "documents")), path))
    back = spark.read.json(path)
    assert back.count() == 1 and set(back.columns) == set(report)
    return back.select("total_documents", "empty_documents", "short_documents", "min_length", "max_length")


def extracted_files(spark, d):
    rows = files.extracted(fixtures.office_files(_t(spark, d, "benchmark")))
    return rows.select("relative_path", "file_name", "extension", "extraction_method", "text", "text_length", "units", F.col("error").isNotNull().alias("failed"))


def extracted_corpus(spark, d):
    rows = files.corpus_of(files.extracted(fixtures.office_files(_t(spark, d, "benchmark"))))
    return rows.select("file_name", F.length("document_id").alias("id_length"), (F.col("document_id") == F.col("sha256")).alias("id_is_hash"), F.col("extracted_at").isNotNull().alias("stamped"))


def extraction_counts(spark, d):
    s = files.extraction_stats(files.extracted(fixtures.office_files(_t(spark, d, "benchmark"))))
    return s.select("discovered", "processed", "empty", "failed", "ocr_documents", F.size("errors").alias("errors"), *(F.coalesce(F.col("extensions")[f".{x}"], F.lit(0).cast("long")).alias(x) for x in ("docx", "pptx", "xlsx", "md", "pdf")))


def routed_pdfs(spark, d):
    """The choice between a PDF's own text and OCR, by readers that stand in for them."""
    read = files.pdf_reader(lambda data: [data.decode()[:60]], lambda data: [data.decode()[: len(data) // 2]])
    items = _t(spark, d, "benchmark").select(F.format_string("/in/%d.pdf", "item_id").alias("path"), F.format_string("%d.pdf", "item_id").alias("relative_path"), F.format_string("%d.pdf", "item_id").alias("file_name"), F.lit(".pdf").alias("extension"), F.translate(F.regexp_replace("text", "[^a-zA-Z ]", "x"), " ", "_").cast("binary").alias("content"))
    return files.extracted(items, {".pdf": read}).select("file_name", "extraction_method", "text_length", "units")


def discovered_files(spark, d):
    """Text files found by suffix in nested folders, the first by path parts, and read."""
    path = fixtures.folder(spark)
    rows = _t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.concat("r_name", F.lit("\r\n\n\n\n"), "r_name", F.lit(" \t "), F.col("r_regionkey").cast("string")).alias("value"))
    rows.repartition(1).write.partitionBy("k").text(path)
    found = files.extracted(files.discovered(spark, path, most=3))
    return found.select(F.regexp_extract("relative_path", r"k=(\d+)/", 1).alias("folder"), "extension", "extraction_method", "text", "units")


def _lines(spark, d):
    """(line, value): records of conversations in order, with broken, blank and odd ones among them."""
    rows = _pairs(spark, d).withColumn("line", F.row_number().over(Window.orderBy("document_id", "pos")).cast("long"))
    n = F.col("line") % 10
    record = F.struct(
        F.when(n != 1, F.col("document_id").cast("string")).alias("document_id"),
        F.when(n == 2, "").otherwise(F.lit("chat")).alias("document_type"),
        F.when(n == 3, " \t").otherwise(F.concat(F.lit(" "), "instruction")).alias("instruction"),
        F.when(n == 4, "").otherwise(F.col("output")).alias("output"),
    )
    return rows.select("line", F.when(n == 5, "{").when(n == 6, " \t ").when(n == 7, "[1]").otherwise(F.to_json(record)).alias("value"))


def validated_lines(spark, d):
    """Lines of files in several parts, numbered over all of them, with their first errors."""
    path = fixtures.folder(spark)
    _lines(spark, d).repartitionByRange(3, "line").sortWithinPartitions("line").select("value").write.text(path)
    return validate.checked(validate.numbered_lines(spark, path)).select("line", "error", "document_id", "document_type", "instruction", "input", "output")


def first_bad_line(spark, d):
    """What validation of a whole file says, and what is left of its output."""
    path = fixtures.folder(spark)
    _lines(spark, d).orderBy("line").coalesce(1).select("value").write.text(f"{path}/in")
    try:
        validate.validate_jsonl(spark, f"{path}/in", f"{path}/out")
        message = "none"
    except validate.ValidationError as e:
        message = str(e)
    return spark.createDataFrame([(message,)], "message string")


def missing_ids(spark, d):
    rows = _pairs(spark, d).select(F.when((F.col("document_id") + F.col("pos")) % 50 != 8, F.col("document_id").cast("string")).alias("document_id"), (F.col("document_id") * 1000 + F.col("pos")).alias("ord"))
    try:
        split.check_ids(rows, "ord")
        message = "none"
    except ValueError as e:
        message = str(e)
    return spark.createDataFrame([(message,)], "message string")


def _reply(text: str, n: int) -> str:
    """A generator for tests: fails, refuses or answers by the length of what it is shown."""
    kind = len(text) % 7
    if kind == 0:
        raise RuntimeError("no answer")
    if kind == 1:
        return "I can't."
    pairs = [{"instruction": "What?", "input": None, "output": text}, {"instruction": " what ", "input": "", "output": text}, {"instruction": "", "output": "x"}, {"instruction": "Else?", "output": "zzzzzzz yyyyyyy"}]
    return f"```json\n{json.dumps([*pairs[:n], 5])}\n```"


def _corpus(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("document_id"), F.when(F.col("item_id") % 9 == 3, " \n").otherwise(F.col("text")).alias("text"), F.col("item_id").alias("ord"))


def generated_counters(spark, d):
    done = _t(spark, d, "benchmark").where(F.col("item_id") % 11 == 4).select(F.col("item_id").cast("string").alias("document_id"))
    _records_, stats = qa.build_dataset(_corpus(spark, d), _reply, done, most=None, questions=4, max_chars=120)
    return stats


def generated_records(spark, d):
    records, _stats = qa.build_dataset(_corpus(spark, d), _reply, most=None, questions=4)
    return records


def streamed_records(spark, d):
    """Records of a stream of JSON lines that is read in two runs; the second adds what the first did not have."""
    from .streaming import resume

    path = fixtures.folder(spark)
    rows = _corpus(spark, d).drop("ord")
    jsonl.write_jsonl(rows.where(F.col("document_id").cast("long") % 2 == 0), f"{path}/in", append=True)
    for _ in range(2):
        resume.start(spark, f"{path}/in", f"{path}/out", f"{path}/log", lambda text, n: json.dumps([{"instruction": "What?", "output": text}])).awaitTermination()
        jsonl.write_jsonl(rows, f"{path}/in", append=True)
    return jsonl.read_jsonl(spark, f"{path}/out", jsonl.QA_RAW).select("document_id", "instruction", "output", "grounding")


def predictions(spark, d):
    said = sft.predicted(_records(spark, d), lambda messages, n: f"{messages[0][0]} {len(messages[1][1])} {n}", "base-model", most=500)
    return said.withColumn("label", sft.model_label(F.when(F.length("prediction") % 2 == 0, "tuned"), F.lit("base-model")))


def evaluated_columns(spark, d):
    """Scores beside all columns that came in."""
    rows = _pairs(spark, d).select("document_id", "pos", F.lit("m").alias("model"), "instruction", F.col("output").alias("reference"), F.when(F.col("pos") % 4 == 0, F.lit(None)).otherwise(F.concat("output", F.lit("!"))).alias("prediction"))
    path = fixtures.folder(spark)
    jsonl.write_jsonl(evaluate.evaluated(rows), path)
    return spark.read.schema("document_id long, pos long, model string, instruction string, reference string, prediction string, exact_match boolean, token_recall double").json(path)


def split_folders(spark, d):
    path = fixtures.folder(spark)
    split.write_splits(split.split_records(_pairs(spark, d), cap=100), path)
    parts = [spark.read.schema("document_id string").json(f"{path}/{s}").agg(F.lit(s).alias("split"), F.count("*").alias("examples"), F.countDistinct("document_id").alias("documents")) for s in ("all", "train", "validation", "test")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


def split_capped(spark, d):
    return split.assigned(split.ranked_ids(_t(spark, d, "documents"), key="doc_id"), cap=100)


def split_leak_report(spark, d):
    """The leak check over a split by record, which must find the documents that it cuts."""
    rows = _pairs(spark, d).withColumn("split", F.when(F.col("pos") % 3 == 0, "train").otherwise(F.lit("test")))
    return split.leaks(rows)


def dataset_versions(spark, d):
    """The version doesn't change with the order of rows, and does with their contents."""
    rows = _pairs(spark, d)
    a, b, c = (evaluate.dataset_hash(x).first() for x in (rows, rows.orderBy(F.desc("pos")), rows.withColumn("pos", F.col("pos") + 1)))
    return spark.createDataFrame([(a["examples"], a["version"] == b["version"], a["version"] == c["version"])], "examples long, same boolean, changed_same boolean")


def heading_types(spark, d):
    """The type dictionary over headings that stand before documents."""
    docs = _t(spark, d, "documents")
    heads = F.array(*(F.lit(h) for h in HEADINGS))
    text = F.concat(F.get(heads, F.col("doc_id") % len(HEADINGS)), F.lit("\n"), F.get(heads, F.col("doc_id") * 7 % len(HEADINGS)), F.lit(" "), "text")
    return docs.select("doc_id", document_type(text).alias("document_type"))


_ALL = (
    jsonl_overwrite, jsonl_append, training_records, profile_report, extracted_files, extracted_corpus, extraction_counts, routed_pdfs, discovered_files, validated_lines, first_bad_line, missing_ids,
    generated_counters, generated_records, streamed_records, predictions, evaluated_columns, split_folders, split_capped, split_leak_report, dataset_versions, heading_types,
)

QUERIES = {f.__name__: f for f in _ALL}


def _clean(x: str) -> str:
    return _strip(rf"regexp_replace(regexp_replace(replace({x}, chr(0), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


_FILES_SQL = f"""f AS (SELECT item_id, ['.docx', '.pptx', '.xlsx', '.md', '.pdf'][item_id % 5 + 1] AS extension, coalesce(text, '') AS t FROM benchmark),
e AS (SELECT item_id, extension, item_id::VARCHAR || extension AS file_name, extension[2:] || '/' || item_id::VARCHAR || extension AS relative_path, {_clean('''CASE extension
    WHEN '.docx' THEN CASE WHEN %s = '' THEN '' ELSE %s || chr(10) END || '[TABLE 1]' || chr(10) || item_id::VARCHAR || ' | cell'
    WHEN '.pptx' THEN '[SLIDE 1]' || CASE WHEN %s = '' THEN '' ELSE chr(10) || %s END
    WHEN '.xlsx' THEN '[SHEET: Items]' || chr(10) || item_id::VARCHAR || ' | ' || t
    WHEN '.md' THEN t END''' % ((_strip('t'),) * 4))} AS text, CASE extension WHEN '.docx' THEN 2 WHEN '.pdf' THEN NULL ELSE 1 END AS units, extension = '.pdf' AS failed FROM f)"""

_LINES_SQL = f"""{_PAIRS_SQL}, l AS (SELECT row_number() OVER (ORDER BY document_id, pos) AS line, * FROM pairs), n AS (SELECT *, line % 10 AS n FROM l),
v AS (SELECT line, CASE WHEN n = 5 THEN 'invalid JSON' WHEN n = 7 THEN 'expected a JSON object' WHEN n = 1 THEN '''document_id'' must be a non-empty string'
  WHEN n = 3 OR {_strip('instruction')} = '' THEN '''instruction'' must be a non-empty string' WHEN n = 4 OR {_strip('output')} = '' THEN '''output'' must be a non-empty string' END AS error,
  document_id::VARCHAR AS document_id, CASE WHEN n = 2 THEN 'unknown' ELSE 'chat' END AS document_type, {_strip('instruction')} AS instruction, '' AS input, {_strip('output')} AS output FROM n WHERE n <> 6)"""

_CORPUS_SQL = "c AS (SELECT item_id, CASE WHEN item_id % 9 = 3 THEN '' ELSE " + _strip("text") + " END AS text FROM benchmark)"

_GEN_SQL = """g AS (SELECT item_id, text, length(text[1:{n}]) % 7 AS kind, text[1:{n}] AS shown FROM c WHERE text <> ''{more})"""


def _types_sql(types) -> str:
    return ", ".join(f"{{'at': {_at('head', p)}, 'no': {i}, 'name': '{name}'}}" for i, (name, p) in enumerate(types))


_HEADS = "[" + ", ".join(f"'{h}'" for h in HEADINGS) + "]"

SQL = {
    "jsonl_overwrite": "SELECT doc_id::VARCHAR AS document_id, NULL::VARCHAR AS document_type, lang AS instruction, source AS input, text AS output FROM documents",
    "jsonl_append": "SELECT source AS input, count(*) AS n, sum(length(text))::BIGINT AS characters FROM documents GROUP BY source",
    "training_records": f"WITH {_RECORDS_SQL} SELECT true AS parsed, 2 AS messages, output AS answer FROM records",
    "profile_report": f"SELECT count(*) AS total_documents, count_if({_strip("coalesce(text, '')")} = '')::BIGINT AS empty_documents, count_if(length(coalesce(text, '')) < 100)::BIGINT AS short_documents, min(length(coalesce(text, '')))::BIGINT AS min_length, max(length(coalesce(text, '')))::BIGINT AS max_length FROM documents",
    "extracted_files": f"WITH {_FILES_SQL} SELECT relative_path, file_name, extension, CASE WHEN NOT failed THEN 'native' END AS extraction_method, text, length(text)::BIGINT AS text_length, units, failed FROM e",
    "extracted_corpus": f"WITH {_FILES_SQL} SELECT file_name, 64 AS id_length, true AS id_is_hash, true AS stamped FROM e WHERE NOT failed AND text <> ''",
    "extraction_counts": f"WITH {_FILES_SQL} SELECT count(*) AS discovered, count_if(NOT failed AND text <> '')::BIGINT AS processed, count_if(NOT failed AND text = '')::BIGINT AS empty, count_if(failed)::BIGINT AS failed, 0::BIGINT AS ocr_documents, count_if(failed)::INT AS errors, "
    + ", ".join(f"count_if(extension = '.{x}')::BIGINT AS {x}" for x in ("docx", "pptx", "xlsx", "md", "pdf")) + " FROM e",
    "routed_pdfs": """WITH t AS (SELECT item_id::VARCHAR || '.pdf' AS file_name, length(text) AS n FROM benchmark), r AS (SELECT file_name, least(n, 60) AS native, n // 2 AS ocr FROM t)
      SELECT file_name, CASE WHEN native + 9 < 100 AND ocr > native THEN 'ocr' ELSE 'native' END AS extraction_method, (9 + CASE WHEN native + 9 < 100 AND ocr > native THEN ocr ELSE native END)::BIGINT AS text_length, 1 AS units FROM r""",
    "discovered_files": "SELECT r_regionkey::VARCHAR AS folder, '.txt' AS extension, 'native' AS extraction_method, r_name || chr(10) || chr(10) || r_name || ' ' || r_regionkey::VARCHAR AS text, 1 AS units FROM region WHERE r_regionkey < 3",
    "validated_lines": f"WITH {_LINES_SQL} SELECT line, error, " + ", ".join(f"CASE WHEN error IS NULL THEN {c} END AS {c}" for c in validate.FIELDS) + " FROM v",
    "first_bad_line": f"WITH {_LINES_SQL} SELECT coalesce((SELECT 'Line ' || line::VARCHAR || ': ' || error || '.' FROM v WHERE error IS NOT NULL ORDER BY line LIMIT 1), 'none') AS message",
    "missing_ids": f"WITH {_PAIRS_SQL}, o AS (SELECT row_number() OVER (ORDER BY document_id * 1000 + pos) AS r, (document_id + pos) % 50 = 8 AS bad FROM pairs) SELECT coalesce('record ' || min(r)::VARCHAR || ': document_id is missing; validate the dataset first', 'none') AS message FROM o WHERE bad",
    "generated_counters": f"""WITH {_CORPUS_SQL}, {_GEN_SQL.format(n=120, more=" AND item_id % 11 <> 4")}, a AS (SELECT *, {_grounding(_stems('shown'), _stems('text'))} >= 0.6::DOUBLE AS good FROM g WHERE kind > 1)
      SELECT (SELECT count(*) FROM a) AS documents, (SELECT count(*) FROM g WHERE kind < 2) AS failed, (SELECT count(*) FROM c WHERE item_id % 11 = 4) AS skipped_done, (SELECT count(*) FROM c WHERE text = '' AND item_id % 11 <> 4) AS skipped_empty,
      (SELECT count_if(good)::BIGINT FROM a) AS examples, (SELECT count(*) FROM a) AS empty, (SELECT count_if(good)::BIGINT FROM a) AS duplicates, (SELECT (count(*) + 2 * count_if(NOT good))::BIGINT FROM a) AS ungrounded""",
    "generated_records": f"""WITH {_CORPUS_SQL}, {_GEN_SQL.format(n=24000, more="")}, h AS (SELECT *, lower(text[1:600]) AS head FROM g WHERE kind > 1)
      SELECT item_id::VARCHAR AS document_id, coalesce(list_min(list_filter([{_types_sql(DOCUMENT_TYPES)}], lambda x: x.at IS NOT NULL)).name, 'unknown') AS document_type, 'What?' AS instruction, text AS input, text AS output, 1.0::DOUBLE AS grounding FROM h""",
    "streamed_records": f"WITH {_CORPUS_SQL} SELECT item_id::VARCHAR AS document_id, 'What?' AS instruction, text AS output, 1.0::DOUBLE AS grounding FROM c WHERE text <> ''",
    "evaluated_columns": f"""WITH {_PAIRS_SQL}, r AS (SELECT document_id, pos::BIGINT AS pos, 'm' AS model, instruction, output AS reference, CASE WHEN pos % 4 <> 0 THEN output || '!' END AS prediction FROM pairs),
      k AS (SELECT *, {_tokens("coalesce(prediction, '')")} AS p, {_tokens('reference')} AS q FROM r)
      SELECT document_id, pos, model, instruction, reference, prediction, {_norm_a("coalesce(prediction, '')")} = {_norm_a('reference')} AS exact_match, CASE WHEN len(q) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(p, q))::DOUBLE / len(q) END AS token_recall FROM k""",
    "split_capped": f"WITH ranked AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS r, least(100, count(*) OVER ()) AS n FROM (SELECT DISTINCT doc_id::VARCHAR AS id FROM documents)) SELECT id AS doc_id, CASE WHEN r <= floor(n * 0.9::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM ranked WHERE r <= 100",
    "split_folders": f"""WITH {_PAIRS_SQL}, ranked AS (SELECT id, row_number() OVER (ORDER BY md5('42:' || id), id) AS r, least(100, count(*) OVER ()) AS n FROM (SELECT DISTINCT document_id::VARCHAR AS id FROM pairs)),
      s AS (SELECT p.document_id, CASE WHEN r > 100 THEN NULL WHEN r <= floor(n * 0.9::DOUBLE) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE) + floor(n * 0.05::DOUBLE) THEN 'validation' ELSE 'test' END AS split FROM pairs p JOIN ranked ON id = p.document_id::VARCHAR)
      SELECT 'all' AS split, count(*) AS examples, count(DISTINCT document_id) AS documents FROM s UNION ALL SELECT x, count_if(split = x)::BIGINT, count(DISTINCT CASE WHEN split = x THEN document_id END) FROM s, (VALUES ('train'), ('validation'), ('test')) v(x) GROUP BY x""",
    "split_leak_report": f"WITH {_PAIRS_SQL} SELECT document_id, count(DISTINCT pos % 3 = 0) AS splits FROM pairs GROUP BY document_id HAVING count(DISTINCT pos % 3 = 0) > 1",
    "dataset_versions": f"WITH {_PAIRS_SQL} SELECT count(*) AS examples, true AS same, false AS changed_same FROM pairs",
    "heading_types": f"""WITH h AS (SELECT doc_id, lower(({_HEADS}[doc_id % {len(HEADINGS)} + 1] || chr(10) || {_HEADS}[doc_id * 7 % {len(HEADINGS)} + 1] || ' ' || text)[1:600]) AS head FROM documents)
      SELECT doc_id, coalesce(list_min(list_filter([{_types_sql(DOCUMENT_TYPES)}], lambda x: x.at IS NOT NULL)).name, 'unknown') AS document_type FROM h""",
    "predictions": f"""WITH {_RECORDS_SQL}, t AS (SELECT *, {_strip("coalesce(input, '')")} AS s FROM records),
      u AS (SELECT *, CASE WHEN length(s) <= 500 THEN s ELSE {_strip("chr(8) || (CASE WHEN instr(s[1:500], ' ') > 0 AND length(s[1:500]) - instr(reverse(s[1:500]), ' ') > 400 THEN s[1:length(s[1:500]) - instr(reverse(s[1:500]), ' ')] ELSE s[1:500] END)")}[2:] || ' …' END AS ctx FROM t),
      p AS (SELECT document_id::VARCHAR AS document_id, 'base:base-model' AS model, instruction, output AS reference, 'system ' || (length(instruction) + CASE WHEN ctx = '' THEN 0 ELSE length(ctx) + {len(sft.CONTEXT_HEADING)} END)::VARCHAR || ' 256' AS prediction FROM u)
      SELECT *, CASE WHEN length(prediction) % 2 = 0 THEN 'tuned' ELSE 'base:base-model' END AS label FROM p""",
}

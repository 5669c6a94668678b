"""Curation operators: pairs, validation, split, formatting, evaluation, sources, queries against DuckDB."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry import catalog, file_queries
from quarry.operators import evaluate, profile, qa, sft, split, validate
from quarry.sources import files, jsonl

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES | file_queries.QUERIES))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "pages", "benchmark", "region"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = (catalog.QUERIES | file_queries.QUERIES)[name](spark, SF)
    other = con.sql((catalog.SQL | file_queries.SQL)[name])
    assert sorted(df.columns) == sorted(other.columns)
    by_name = lambda columns, rows: sorted(repr([r[columns.index(c)] for c in sorted(columns)]) for r in rows)
    assert by_name(df.columns, [tuple(r) for r in df.collect()]) == by_name(other.columns, other.fetchall())


def test_replies():
    assert qa.parse_reply('```json\n[{"instruction": "q"}]\n```') == [{"instruction": "q"}]
    assert qa.parse_reply("here: [1, 2] end") == [1, 2]
    for bad in ("none", "] [", "[1"):
        with pytest.raises(ValueError):
            qa.parse_reply(bad)
    assert qa.coerced([{"instruction": None, "output": True}, 3])[0] == {"is_object": True, "instruction": "None", "input": "", "output": "True"}


def test_dataset_with_statistics_and_resume(spark):
    corpus = spark.createDataFrame([("d1", "Ответственный Иванов. Срок пять дней.", 1), ("d2", "  ", 2), ("d3", "сбой", 3), ("d4", "готово", 4)], "document_id string, text string, ord int")
    done = spark.createDataFrame([("d4",)], "document_id string")

    def reply(text, n):
        if text == "сбой":
            raise RuntimeError("no")
        pairs = [("Кто ответственный?", "Совсем другое слово"), ("Кто ответственный?", "Иванов"), ("кто  ответственный", "Иванов"), ("Срок?", "Вымышленный текст"), ("", "x")]
        return json.dumps([*({"instruction": a, "input": "", "output": b} for a, b in pairs), "text"])

    records, stats = qa.build_dataset(corpus, reply, done)
    got = records.collect()
    assert [(r["document_id"], r["output"], r["grounding"]) for r in got] == [("d1", "Иванов", 1.0)]
    assert stats.first().asDict() == {"documents": 1, "failed": 1, "skipped_done": 1, "skipped_empty": 1, "examples": 1, "empty": 1, "duplicates": 1, "ungrounded": 2}


def test_counters_with_null_input(spark):
    # The benchmark of sf0.1 holds texts with the letters "none", which a null input must not quote.
    corpus = spark.createDataFrame([("d1", "Oneshe thinoned eroues.", 1), ("d2", "Nobody answered.", 2)], "document_id string, text string, ord int")

    def reply(text, n):
        return json.dumps([{"instruction": "What?", "input": None, "output": text}, {"instruction": " what ", "input": "", "output": text}])

    _records, stats = qa.build_dataset(corpus, reply)
    got = stats.first().asDict()
    assert (got["examples"], got["duplicates"], got["ungrounded"]) == (2, 2, 0)
    assert qa.coerced([{"instruction": None, "input": None, "output": "x"}]) == [{"is_object": True, "instruction": "None", "input": "", "output": "x"}]
    assert qa.coerced([{"input": "None"}, {"input": False}])[0]["input"] == "None"


def test_records_with_null_input(spark):
    """The first of equal questions is the record, and its context is the text, whatever letters that holds."""
    long = "\n".join(["Oneshe thinoned eroues.", *["filler words here"] * 30])
    corpus = spark.createDataFrame([("d1", "Oneshe thinoned eroues.", 1), ("d2", "None", 2), ("d3", long, 3)], "document_id string, text string, ord int")

    def reply(text, n):
        return json.dumps([{"instruction": "What?", "input": None, "output": text[:23]}, {"instruction": " what ", "input": "", "output": text[:23]}])

    records, _stats = qa.build_dataset(corpus, reply, size=100)
    got = {r["document_id"]: (r["instruction"], r["input"], r["grounding"]) for r in records.collect()}
    assert got["d1"] == ("What?", "Oneshe thinoned eroues.", 1.0) and got["d2"] == ("What?", "None", 1.0)
    assert got["d3"][0] == "What?" and got["d3"][1].startswith("Oneshe thinoned eroues.\n") and len(got) == 3


def test_first_accepted_as_in_order(spark):
    rng = random.Random(5)
    rows = [(d, p, rng.choice("abc"), rng.random() < 0.2, rng.choice([0.1, 0.6, 0.9])) for d in range(60) for p in range(8)]
    df = spark.createDataFrame(rows, "d int, pos int, key string, empty boolean, score double")
    got = {(r["d"], r["pos"]): r["s"] for r in df.withColumn("s", qa.status(F.col("empty"), F.col("score"), F.col("pos"), ["d"], F.col("key"))).collect()}
    seen = set()
    for d, p, key, empty, score in rows:
        want = "empty" if empty else "duplicate" if (d, key) in seen else "ungrounded" if score < 0.6 else "accepted"
        if want == "accepted":
            seen.add((d, key))
        assert got[d, p] == want


def test_validation(spark, tmp_path):
    good = [{"document_id": 7, "instruction": " q ", "output": "a", "document_type": None, "grounding": 1}, {"document_id": "x", "instruction": "q", "input": "c", "output": "a", "document_type": " "}]
    (tmp_path / "in.jsonl").write_text("\n".join([json.dumps(good[0]), "", json.dumps(good[1])]))
    assert validate.validate_jsonl(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out")) == 2
    rows = {r["document_id"]: r for r in jsonl.read_jsonl(spark, str(tmp_path / "out"), jsonl.RECORD).collect()}
    assert rows["7"]["document_type"] == "unknown" and rows["7"]["instruction"] == "q" and rows["x"]["document_type"] == ""
    bad = {"x": "{", "list": "[1]", "id": '{"instruction": "q", "output": "a"}', "input": '{"document_id": "d", "instruction": "q", "output": "a", "input": 3}'}
    for name, line in bad.items():
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(good[0]) + "\n\n" + line + "\n")
        with pytest.raises(ValueError, match="Line 3"):
            validate.validate_jsonl(spark, str(tmp_path / f"{name}.jsonl"), str(tmp_path / f"{name}-out"))
        assert not (tmp_path / f"{name}-out").exists()


def test_split(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i // 3}", "q", i) for i in range(120)], "document_id string, instruction string, ord int")
    out = split.split_records(rows)
    s = split.summary(out).first()
    assert (s["documents"], s["examples"], s["train_documents"], s["validation_documents"], s["test_documents"], s["train_examples"]) == (40, 120, 36, 2, 2, 108)
    assert split.leaks(out).isEmpty()
    capped = split.summary(split.split_records(rows, cap=10)).first()
    assert (capped["documents"], capped["examples"], capped["train_documents"]) == (10, 120, 9)
    exact = split.assigned(split.shuffled_ids(rows, "ord"))
    ids = [f"d{i}" for i in range(40)]
    random.Random(42).shuffle(ids)
    assert {r[0] for r in exact.where("split = 'train'").collect()} == set(ids[:36])
    split.write_splits(out, str(tmp_path))
    assert spark.read.json(str(tmp_path / "all")).count() == 120 and spark.read.json(str(tmp_path / "test")).count() == 6
    with pytest.raises(ValueError):
        split.check_ratios(0.9, 0.1)
    with pytest.raises(ValueError, match="record 2"):
        split.check_ids(spark.createDataFrame([("a", 1), (" ", 2)], "document_id string, ord int"), "ord")


def test_formatting_and_budget(spark):
    rows = spark.createDataFrame([("d", "t", "вопрос", "контекст " * 600, "полный ответ"), ("e", "t", "вопрос", None, "ответ")], "document_id string, document_type string, instruction string, input string, output string")
    out = {r["document_id"]: r for r in sft.formatted(rows).collect()}
    assert [m["role"] for m in out["d"]["prompt"]] == ["system", "user"] and out["d"]["completion"][0]["content"] == "полный ответ"
    assert "полный ответ" not in out["d"]["prompt"][1]["content"] and out["e"]["prompt"][1]["content"] == "вопрос"
    n = len((sft.SYSTEM_PROMPT + " вопрос ответ").split())
    assert sft.within_budget(sft.formatted(rows), most=n).count() == 1 and sft.within_budget(sft.formatted(rows), most=n - 1).count() == 0
    with pytest.raises(RuntimeError):
        sft.filter_by_length(sft.formatted(rows), most=1)
    said = sft.predicted(rows, lambda messages, n: f"{messages[1][0]} {n}", "base-model").collect()
    assert {(r["model"], r["prediction"]) for r in said} == {("base:base-model", "user 256")}


def test_percentile_rank_is_half_even(spark):
    lengths = spark.createDataFrame([(v,) for v in (10, 20, 30, 40)], "n long")
    assert profile.nearest_rank(lengths, (0.5,)).first()["value"] == 30
    rng = random.Random(3)
    values = [rng.randrange(50) for _ in range(137)]
    got = {r["share"]: r["value"] for r in profile.nearest_rank(spark.createDataFrame([(v,) for v in values], "n long"), (0.5, 0.9, 0.99)).collect()}
    assert got == {p: sorted(values)[round((len(values) - 1) * p)] for p in (0.5, 0.9, 0.99)}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "text string")
    assert profile.corpus_profile(none).first()["total_documents"] == 0
    scores = evaluate.evaluation_summary(evaluate.evaluated(spark.createDataFrame([], "prediction string, reference string"))).first()
    assert (scores["examples"], scores["exact_match"]) == (0, 0.0)


def office(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name, xml)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_extraction(spark, tmp_path):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    docx = office({"word/document.xml": f"<w:document {W}><w:body>{p('one')}{p('')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('two')}</w:body></w:document>"})
    xlsx = office({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="First" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row><c r="A2"/></row></sheetData></worksheet>',
    })
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.DOCX").write_bytes(docx)
    (tmp_path / "b.xlsx").write_bytes(xlsx)
    (tmp_path / "c.txt").write_bytes(b"x\r\ny\xff")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    (tmp_path / "e.bin").write_bytes(b"")
    rows = files.extracted(files.discovered(spark, str(tmp_path))).persist()
    got = {r["relative_path"]: r for r in rows.collect()}
    assert got["sub/a.DOCX"]["text"] == "one\ntwo\n[TABLE 1]\na | b" and got["sub/a.DOCX"]["units"] == 3
    assert got["b.xlsx"]["text"] == "[SHEET: First]\nname | | 5" and got["b.xlsx"]["units"] == 1
    assert got["c.txt"]["text"] == "x\ny" and got["d.pdf"]["error"] and "e.bin" not in got
    stats = files.extraction_stats(rows).first()
    assert (stats["discovered"], stats["processed"], stats["failed"], stats["extensions"][".docx"]) == (4, 3, 1, 1)
    read = files.pdf_reader(lambda data: ["thin"], lambda data: ["a longer text"])
    assert read(b"") == ("[PAGE 1]\na longer text", 1, "ocr")


def test_office_details(spark, tmp_path):
    r = lambda t: f"<w:r>{t}</w:r>"
    t = lambda x: f"<w:t>{x}</w:t>"
    box = f"<w:r><w:txbxContent><w:p>{r(t('BOX'))}</w:p></w:txbxContent></w:r>"
    body = f"<w:p>{r(t('a') + '<w:noBreakHyphen/>' + t('b'))}<w:hyperlink>{r(t('link'))}</w:hyperlink>{box}<w:ins>{r(t('new'))}</w:ins></w:p>"
    cell = lambda x, props="": f"<w:tc><w:tcPr>{props}</w:tcPr><w:p>{r(t(x))}</w:p></w:tc>"
    rows = f"<w:tr>{cell('x', '<w:gridSpan w:val=&quot;2&quot;/>'.replace('&quot;', chr(34)))}{cell('y', '<w:vMerge w:val=&quot;restart&quot;/>'.replace('&quot;', chr(34)))}</w:tr><w:tr>{cell('1')}{cell('2')}{cell('', '<w:vMerge/>')}</w:tr>"
    docx = office({"word/document.xml": f"<w:document {W}><w:body>{body}<w:tbl>{rows}</w:tbl></w:body></w:document>"})
    assert files.read_docx(docx)[0] == "a-blink\n[TABLE 1]\nx | x | y\n1 | 2 | y"
    xlsx = office({
        "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {S}><numFmts><numFmt numFmtId="170" formatCode="[h]:mm"/><numFmt numFmtId="171" formatCode="0.0&quot;d&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {S}><dimension ref="A1:E1"/><sheetData><row><c r="A1" s="1"><v>43831</v></c><c r="B1" s="1"><v>43831.5</v></c><c r="C1" s="2"><v>1.25</v></c><c r="D1" s="3"><v>2.5</v></c></row></sheetData></worksheet>',
    })
    assert files.read_xlsx(xlsx)[0] == "[SHEET: S]\n2020-01-01 00:00:00 | 2020-01-01 12:00:00 | 1 day, 6:00:00 | 2.5 | "
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.TXT").write_text("y" * 100)
    (tmp_path / "c.bin").write_text("z")
    got = {r["relative_path"]: r for r in files.extracted(files.discovered(spark, str(tmp_path), largest=50)).collect()}
    assert set(got) == {"a.txt", "b.TXT"} and got["a.txt"]["text"] == "x" and "too large" in got["b.TXT"]["error"]
    assert [r["relative_path"] for r in files.discovered(spark, str(tmp_path), 1).collect()] == ["a.txt"]


def test_endpoint():
    import http.server
    import threading

    from quarry.sources import endpoint

    asked = []

    class Model(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"choices": [{"message": {"content": "[1]"}}]}).encode()
            self.send_response(200 if asked[-1][1]["model"] == "m" else 500)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/v1/"
    assert qa.parse_reply(endpoint.endpoint("m", url, 5)("текст", 3)) == [1]
    path, body = asked[0]
    assert path == "/v1/chat/completions" and body["temperature"] == 0.2 and "3" in body["messages"][1]["content"] and body["messages"][1]["content"].endswith("текст")
    with pytest.raises(OSError):
        endpoint.endpoint("other", url, 5)("x", 1)
    server.shutdown()


def test_commands(spark, tmp_path, capsys):
    from quarry.__main__ import main, parser

    defaults = vars(parser().parse_args(["generate-qa-dataset", "--input", "a", "--output", "b", "--model", "m"]))
    assert (defaults["questions_per_document"], defaults["max_documents"], defaults["max_chars"], defaults["timeout"], defaults["context_chars"], defaults["min_grounding"], defaults["resume"]) == (5, 500, 24000, 300, 1800, 0.6, False)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("one two")
    (tmp_path / "in" / "b.pdf").write_bytes(b"%PDF")
    main(["extract-documents", "--input-dir", str(tmp_path / "in"), "--output", str(tmp_path / "corpus")])
    assert '"processed":1' in capsys.readouterr().out
    main(["inspect-corpus", "--input", str(tmp_path / "corpus")])
    assert "'total_documents': 1" in capsys.readouterr().out
    rows = [{"document_id": f"d{i}", "document_type": None, "instruction": "q", "input": "c", "output": "a"} for i in range(40)]
    (tmp_path / "raw.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n \t\n")
    main(["prepare-dataset", "--input", str(tmp_path / "raw.jsonl"), "--output", str(tmp_path / "valid")])
    main(["split-dataset", "--input", str(tmp_path / "valid"), "--output-dir", str(tmp_path / "split")])
    main(["format-sft-dataset", "--input", str(tmp_path / "split" / "train"), "--output", str(tmp_path / "sft")])
    assert capsys.readouterr().out.split() == ["40", "36"] and jsonl.read_training(spark, str(tmp_path / "sft")).count() == 36
    with pytest.raises(SystemExit):
        main(["split-dataset"])


def test_line_numbers_over_several_files(spark, tmp_path):
    want, parts = [], {"part-00000": 2, "part-00001": 50, "part-00002": 3}
    for name, n in parts.items():
        lines = [f"{name} {i}" if i % 3 else "" for i in range(n)]
        (tmp_path / f"{name}.json").write_text("\n".join(lines) + "\n")
        want += lines
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = {r["line"]: r["value"] for r in validate.numbered_lines(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(want, 1))


def test_field_rules(spark):
    cases = {
        '{"document_id": true, "instruction": "q", "output": "a"}': ("True", "unknown", None),
        '{"document_id": 12345678901234567890123, "instruction": "q", "output": "a", "document_type": 0}': ("12345678901234567890123", "unknown", None),
        '{"document_id": 1.5, "instruction": "q", "output": "a"}': (None, None, "'document_id' must be a non-empty string"),
        '{"document_id": "d", "instruction": ["q"], "output": "a"}': (None, None, "'instruction' must be a non-empty string"),
        '{"document_id": "d", "instruction": "q", "output": " \\t"}': (None, None, "'output' must be a non-empty string"),
        '{"document_id": "d", "instruction": "q", "output": "a", "document_type": "0", "input": null}': ("d", "0", None),
        '{"document_id": "d", "instruction": "q", "output": "a", "document_type": [1]}': (None, None, "'document_type' must be a string"),
        '{"document_id": "d", "instruction": "q", "output": "a", "document_type": {}}': ("d", "unknown", None),
        '"text"': (None, None, "expected a JSON object"),
        "{": (None, None, "invalid JSON"),
    }
    rows = spark.createDataFrame(list(enumerate(cases, 1)), "line long, value string")
    got = {r["line"]: (r["document_id"], r["document_type"], r["error"]) for r in validate.checked(rows).collect()}
    assert got == dict(enumerate(cases.values(), 1))


def test_stream_resumes(spark, tmp_path):
    from quarry.streaming import resume

    (tmp_path / "in").mkdir()
    line = lambda i: json.dumps({"document_id": i, "text": f"слово {i} текст"}) + "\n"
    reply = lambda text, n: json.dumps([{"instruction": "что", "output": text}])
    (tmp_path / "in" / "1.jsonl").write_text(line("a"))
    for _ in range(2):
        resume.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), reply).awaitTermination()
        (tmp_path / "in" / "2.jsonl").write_text(line("a") + line("b"))
    got = jsonl.read_jsonl(spark, str(tmp_path / "out"), jsonl.QA_RAW).collect()
    assert sorted(r["document_id"] for r in got) == ["a", "b"]

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import functions as F

from chunkweave.operators import chunkers as C
from chunkweave.operators import segments as G
from chunkweave.operators.packing import ChunkingOptions

JAVA = """/* Licence
 */
package demo.app;

import java.util.List;

@Service
public class Greeter {
    private final String name;

    public String greet(String who) {
        return "hi " + who;
    }
}
"""


def spans(rows):
    return [(r.kind, r.start_line, r.end_line, r.symbol) for r in rows]


def test_java_segments_close_with_their_braces(value):
    got = value(G.java_segments, "p string, c string", "A.java", JAVA)
    assert spans(got) == [("class_header", 8, 14, "Greeter")]
    text = "\n".join(JAVA.splitlines()[7:14])
    assert got[0].text == text
    assert got[0].id == "A.java:class_header:8:" + hashlib.sha256(text.encode()).hexdigest()[:10]
    nothing = value(G.java_segments, "p string, c string", "B.java", "int x\n")
    assert spans(nothing) == [("java_file", 1, 1, None)]
    open_end = value(G.java_segments, "p string, c string", "C.java", "enum A {\n x\n")
    assert spans(open_end) == [("class_header", 1, 2, "A")]


def test_code_and_heading_segments(value):
    code = "import x\n\ndef one():\n  pass\n\nclass Two:\n  y = 1\n"
    assert spans(value(G.code_segments, "p string, c string", "m.py", code)) == [
        ("code_lead", 1, 2, None),
        ("code_symbol", 3, 5, "one"),
        ("code_symbol", 6, 7, "Two"),
    ]
    whole = value(G.code_segments, "p string, c string", "m.py", "x = 1\n")
    assert spans(whole) == [("code_block", 1, 1, None)]
    assert whole[0].id.endswith(hashlib.sha256(b"x = 1\n").hexdigest()[:10])
    text = "lead\n# One #\ntext\n####### no\n## Two\n"
    found = value(G.heading_segments, "p string, c string", "d.md", text)
    assert spans(found) == [("markdown_lead", 1, 1, None), ("heading_section", 2, 4, "One #"), ("heading_section", 5, 5, "Two")]
    assert found[0].text == "lead" and found[0].id.endswith(hashlib.sha256(b"lead").hexdigest()[:10])
    blank = value(G.code_segments, "p string, c string", "m.py", "\n  \ndef one():\n")
    assert spans(blank) == [("code_symbol", 3, 3, "one")]
    without = value(lambda p, c: G.heading_segments(p, c, lead=False), "p string, c string", "d.md", text)
    assert spans(without) == spans(found)[1:]


def test_sections_keep_the_lead(value):
    got = value(G.heading_sections, "c string", "lead\n#A\nx\n# B\n\n")
    assert [(s.title, s.text) for s in got] == [("", "lead"), ("#A", "#A\nx"), ("# B", "# B")]


def test_brace_sections(value):
    text = "a {\n\n b\n}\n\nc\n"
    assert value(G.brace_sections, "c string", text) == ["a {\n\n b\n}", "c"]
    long = "\n".join(f"x{i}" for i in range(85))
    assert [len(p.splitlines()) for p in value(G.brace_sections, "c string", long)] == [40, 40, 5]
    assert [len(p.splitlines()) for p in value(lambda c: G.brace_sections(c, 30), "c string", long)] == [30, 30, 25]


def test_json_members_are_indented(spark):
    content = '{"a": {"b": [1, 2.50]}, "é": "x"}'
    rows = spark.createDataFrame([("x.json", content), ("y.json", "[1]"), ("z.json", "{oops")], "path string, content string")
    with_members = rows.withColumn("members", G.json_members("content"))
    got = {
        r.path: [(s.kind, s.text, s.symbol) for s in r.s]
        for r in with_members.select(
            "path", G.json_segments(F.col("path"), F.col("content"), F.col("members")).alias("s")
        ).collect()
    }
    assert got["x.json"] == [
        ("top_level_key", "a:\n" + json.dumps({"b": [1, 2.5]}, indent=2), "a"),
        ("top_level_key", 'é:\n"x"', "é"),
    ]
    assert got["y.json"] == [("structured_blob", "[1]", None)]
    assert got["z.json"] == [("structured_blob", "{oops", None)]


def test_paragraph_segments(value):
    got = value(G.paragraph_segments, "p string, c string", "t", "one\ntwo\n \n\nthree\n")
    assert [(s.start_line, s.end_line, s.symbol, s.text) for s in got] == [
        (1, 2, "paragraph_1", "one\ntwo"),
        (3, 3, "paragraph_2", "three"),
    ]


def test_file_header(value):
    header = value(G.file_header, "c string", JAVA)
    assert header.splitlines() == [
        "/* Licence", " */", "package demo.app;", "import java.util.List;", "@Service", "public class Greeter {",
    ]
    assert value(G.file_header, "c string", "/* c */\nint x;\nimport y;\n") == "/* c */"
    assert value(G.file_header, "c string", "int x;\nimport y;\nclass A {\n") == "import y;\nclass A {"
    assert value(lambda c: G.file_header(c, 7), "c string", JAVA) == "/* Lice"
    assert value(G.file_header, "c string", " \n") == ""


def test_routing_and_determinism(spark):
    files = [
        ("a.py", ".py", "import os\n\ndef hello():\n    return 42\n"),
        ("A.java", ".java", JAVA + "\nclass Other {}\n"),
        ("d.md", ".md", "# T\n\ntext here\n\n## U\n\nmore\n"),
        ("n.txt", ".txt", "one two\n\nthree"),
        ("x.go", ".go", "x\n\ny\n"),
    ]
    sources = spark.createDataFrame(files, "path string, ext string, content string")
    runs = [sorted(map(str, C.structural_chunks(sources).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    by_path = {}
    for r in C.structural_chunks(sources).collect():
        by_path.setdefault(r.path, []).append(r)
    assert {p: rows[0].chunker for p, rows in by_path.items()} == {
        "a.py": "python", "A.java": "java", "d.md": "markdown", "n.txt": "text", "x.go": "code:fallback",
    }
    java = sorted(by_path["A.java"], key=lambda r: r.ord)
    assert java[0].preamble and java[0].id == "A.java:java:preamble"
    assert "// ... code ..." in java[1].text and java[1].text.startswith("/* Licence")
    assert by_path["x.go"][0].text == "x\ny"


def test_parents_limit_symbols_per_chunk(spark):
    code = "\n".join(f"def f{i}():\n  pass" for i in range(3))
    sources = spark.createDataFrame([("a.py", ".py", code)], "path string, ext string, content string")
    options = ChunkingOptions(emit_parent_chunks=True, overlap_tokens=0, include_source_preamble=False)
    got = sorted(C.structural_chunks(sources, options).collect(), key=lambda r: r.ord)
    assert [[b.kind for b in r.blocks_meta] for r in got] == [["symbol", "symbol_child"]] * 3


def test_annotations(value):
    text = "@RestController @GetMapping(\"/x\") class A {} @Value"
    tags = value(lambda c: C.annotation_tags(C.annotations(c)), "c string", text)
    assert {t.tag for t in tags} == {"spring_core.stereotype", "spring_core.injection", "spring_web.mapping", "lombok.data"}
    kind = lambda c: C.annotation_class(C.annotations(c), F.lit("class"))
    assert value(kind, "c string", text) == "controller"
    assert value(kind, "c string", "plain") == "class"


def test_hostile_json_is_one_blob(spark):
    texts = ['{"a": "\\ud800"}', '{"\\udc00": 1}', '{"a":' * 30_000, "[" * 100_000, '{"a": [1, {"b": null}]}', "NaN"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", G.json_members(F.col("t")).alias("m")).collect()
    assert [r.i for r in rows if r.m is not None] == [4]
    assert [r for r in rows if r.i == 4][0].m[0].value == '[\n  1,\n  {\n    "b": null\n  }\n]'


def test_code_chunks_keep_what_the_preamble_does_not(spark):
    from chunkweave.operators.chunkers import structural_chunks
    from chunkweave.operators.packing import ChunkingOptions

    rows = [
        ("a.py", ".py", "import x\nLIMIT = 3\n\ndef one():\n  pass\n"),
        ("b.py", ".py", "import x\n\ndef one():\n  pass\n"),
        ("c.py", ".py", "LIMIT = 3\n"),
    ]
    files = spark.createDataFrame(rows, "path string, ext string, content string")
    texts = {}
    for row in structural_chunks(files, ChunkingOptions(), "python").orderBy("path", "ord").collect():
        texts.setdefault(row.path, []).append(row.text)
    assert texts["a.py"][0] == texts["b.py"][0] == "import x"  # the preamble
    assert any("LIMIT = 3" in t for t in texts["a.py"]) and any("def one" in t for t in texts["a.py"])
    assert sum("LIMIT" in t for t in texts["a.py"]) == 1 and len(texts["b.py"]) == 2 and texts["c.py"] == ["LIMIT = 3"]


def test_header_of_a_long_comment_is_found_in_linear_time(spark):
    comment = "/*\n" + "\n".join(f" * line {i}" for i in range(12000)) + "\n */"
    text = comment + "\nimport a\nclass B {\nimport c\n"
    began = time.monotonic()
    found = spark.createDataFrame([(text,)], "t string").select(G.file_header(F.col("t"), 1 << 20).alias("h")).first().h
    assert found == comment + "\nimport a\nclass B {"
    assert time.monotonic() - began < 20

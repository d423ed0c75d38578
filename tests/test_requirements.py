import pytest
from pyspark.sql import functions as F

from millrace.operators import requirements, rules, sourcecode
from millrace.sources import readers

FOOTER = "Acme Corp 2024 page"
TEXT = "\n".join(
    [
        "System Overview",
        "The system shall store all orders in the archive, e.g. the",
        "ones of last year. Nothing else is said here.",
        "",
        "Page 3 of 12",
        "1. Scope ........ 4",
        f"{FOOTER} 1", "2.1 The user must be able to select an item within 3 seconds.", f"{FOOTER} 2",
        "Note: this should be read by all of you.",
        f"{FOOTER} 3", "Passwords are encrypted at rest in the store [REQ 12]", f"{FOOTER} 4",
        "(deleted) The user shall do nothing at all.", f"{FOOTER} 5", "- wood and stone", f"{FOOTER} 6",
    ]
)


def test_lines_blocks_and_candidates(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "id int, text string")
    kinds = {r.kind: r["count"] for r in requirements.lines(docs.where("id = 1"), "id", "text").groupBy("kind").count().collect()}
    assert kinds == {"blank": 1, "page_number": 1, "toc_line": 1, "header_footer": 6, "text": 8}
    rows = requirements.extract(requirements.blocks(requirements.lines(docs, "id", "text"), "id"), "id").orderBy("line_start").collect()
    got = [(r.line_start, r.clause_label, r.source_marker, r.cleaned_text, r.candidate_type, r.extraction_rule, r.dropped) for r in rows]
    assert got == [
        (1, "", "", "System Overview", "unknown", None, "heading"),
        (2, "", "", "The system shall store all orders in the archive, e.g. the ones of last year.", "FR", "modal_sentence", None),
        (8, "2.1", "", "The user must be able to select an item within 3 seconds.", "unknown", "numbered_clause_modal", None),
        (10, "", "", "Note: this should be read by all of you.", "unknown", None, "note_or_example"),
        (12, "", "REQ 12", "Passwords are encrypted at rest in the store", "NFR", "numbered_clause_no_modal", None),
        (14, "", "", "(deleted) The user shall do nothing at all.", "unknown", None, "deleted"),
        (16, "-", "", "- wood and stone", "unknown", None, "no_requirement_cue"),
    ]
    assert requirements.candidates(docs, "id", "text").count() == 3


def test_sentences_after_abbreviations(spark):
    rows = spark.createDataFrame([("See fig. 3 for more. It is No. 7. Done!",), ("",), (None,)], "t string")
    assert [r.s for r in rows.select(requirements.whole_sentences(F.col("t")).alias("s")).collect()] == [["See fig. 3 for more.", "It is No. 7.", "Done!"], [], None]


def test_production_paths(spark):
    paths = {"src/main/java/a/TestUtil.java": True, "src/test/java/a/A.java": False, "a/FooTests.java": False, "a/Foo.java": True, "a/build/Foo.java": False, "a\\Generated\\Foo.java": False, "a/foo.py": False, "TestA.java": False, "latest/Foo.java": True}
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", sourcecode.production_path(F.col("p")).alias("ok")).collect()
    assert {r.p: r.ok for r in rows} == paths


def test_technology_and_imports(spark):
    files = spark.createDataFrame(
        [("a", "pom.xml", "<x>org.springframework.boot</x>"), ("a", "src/A.java", ""), ("b", "build.gradle.kts", ""), ("b", "B.java", ""), ("c", "x.py", ""), ("c", "pyproject.toml", ""), ("d", "README", None), ("e", "a.tsx", ""), ("f", "sub/pom.xml", "springframework"), ("f", "F.java", "")],
        "repository string, path string, text string",
    )
    got = {r.repository: (r.language, r.technology) for r in sourcecode.technology(files).collect()}
    assert got == {"a": ("Java", "Spring Boot"), "b": ("Java", "Gradle / Java"), "c": ("Python", "Python project"), "d": ("Unknown", "Unknown"), "e": ("TypeScript", "React"), "f": ("Java", "Java")}
    sources = spark.createDataFrame([("a/A.java", "package a.b;\nimport c.C;\n import static c.d.E.x;\nimport c.*;\nclass A {}"), ("c/C.java", "package c;\nclass C {}\nenum D {}"), ("n.java", "import c.C;")], "path string, text string")
    resolved = sourcecode.resolve_imports(sources)
    assert {(r.imported, r.target) for r in resolved.collect()} == {("c.C", "c"), ("c.d.E.x", None), ("c.*", "c")}
    assert [tuple(r) for r in sourcecode.dependencies(resolved).collect()] == [("a.b", "c")]
    assert [tuple(r) for r in sourcecode.unresolved_count(resolved).collect()] == [(3, 1)]
    packages = spark.createDataFrame([("a.b",), ("c",), ("c.d",)], "package string")
    assert {(r.source, r.target, r.evidence) for r in sourcecode.import_evidence(sources, packages).collect()} == {("a.b", "c", "a/A.java:2:import c.C;; a/A.java:4:import c.*;"), ("a.b", "c.d", "a/A.java:3:import static c.d.E.x;")}


def test_results_of_any_case_and_the_last_counts(spark):
    tests = spark.createDataFrame([("A", "m"), ("B", "n")], "class_name string, method_name string")
    results = spark.createDataFrame([("a", "M", "PASS", 1), ("A", "m", "FAIL", 2)], "class_name string, method_name string, status string, at int")
    assert {tuple(r) for r in sourcecode.with_results(tests, results, "at").collect()} == {("A", "m", "FAIL"), ("B", "n", None)}


def test_strict_join_and_labels_refuse(spark):
    rows, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    with pytest.raises(ValueError, match="without a match"):
        rules.strict_left_join(rows, right, ["k"])
    with pytest.raises(ValueError, match="repeats"):
        rules.strict_left_join(rows, right.unionByName(right), ["k"])
    label = rules.violation_label([F.col("a"), F.col("b")]).alias("label")
    assert [r.label for r in spark.createDataFrame([(0, 0), (1, 0), (None, 4)], "a int, b int").select(label).collect()] == [0, 1, None]
    with pytest.raises(Exception, match="negative"):
        spark.createDataFrame([(0, -1)], "a int, b int").select(label).collect()


def test_mutations(spark):
    row = spark.createDataFrame([("It shall take 07 or 0 s. x == True",)], "t string")
    changed = {n: row.select(c.alias("m")).first().m for n, c in rules.mutations(F.col("t")).items()}
    assert changed["negate_behavior"] == "It shall not take 07 or 0 s. x != False"
    assert changed["change_numbers"] == "It shall take 707 or 7 s. x == True"
    assert changed["strip_to_first_sentence"] == "It shall take 07 or 0 s."


def test_html_entities_and_silent_parts(spark):
    html = "<head><title>no</title></head><!-- no --><p>a &lt;b&gt; &#233;&#x1F600; &amp;lt;</p><SCRIPT>no</script >c<br/>d&nbsp; e<style>x"
    page = spark.createDataFrame([(html,), ("",), (None,)], "h string")
    assert [r.t for r in page.select(readers.html_text(F.col("h")).alias("t")).collect()] == ["a <b> é😀 &lt;\nc\nd e", "", None]

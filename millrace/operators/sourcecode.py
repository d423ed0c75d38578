"""Source trees: production paths, import resolution and its evidence, test results by name, technology."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import declared_types, package_name

# Folders that hold no production code.
NO_PRODUCTION = ("test", "tests", "testfixtures", "test-fixtures", "integration-test", "integration-tests", "generated", "target", "build", "out", ".mvn")
IMPORT = r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"
# Extensions in the order in which they decide, with the language and the technology they stand for.
TECHNOLOGIES = ((".java", "Java", "Java"), (".tsx", "TypeScript", "React"), (".jsx", "JavaScript", "React"), (".ts", "TypeScript", "TypeScript"), (".js", "JavaScript", "JavaScript"), (".py", "Python", "Python"), (".cs", "C#", ".NET"), (".go", "Go", "Go"), (".php", "PHP", "PHP"))


def production_path(path: Column, suffix: str = ".java", excluded: Sequence[str] = NO_PRODUCTION) -> Column:
    """Whether a source file is production code: no excluded folder; a test's name only counts outside ``src/main``."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    main = low.rlike(r"(^|/)src/main(/|$)")
    named = low.rlike(rf"(^|/)test[^/]*$|(test|tests|testcase)\{suffix}$")
    return low.endswith(suffix) & ~F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, excluded))) & (main | ~named)


def humanized(name: Column) -> Column:
    """A method's name as words."""
    return F.trim(F.replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))


def import_lines(files: DataFrame) -> DataFrame:
    """(path, package, line_number, code, imported) for every import line of ``files`` (path, text)."""
    rows = files.select("path", package_name(F.col("text")).alias("package"), F.posexplode(F.split("text", "\r?\n")).alias("at", "line"))
    found = rows.withColumn("imported", F.regexp_extract("line", IMPORT, 1)).where("imported <> '' and package <> ''")
    return found.select("path", "package", (F.col("at") + 1).alias("line_number"), F.trim("line").alias("code"), "imported")


def resolve_imports(files: DataFrame) -> DataFrame:
    """Import lines with ``target``: the package of the imported type, or the imported package; null where unknown."""
    declared = files.select(package_name(F.col("text")).alias("target"), F.explode(declared_types(F.col("text"))).alias("type")).where("target <> ''")
    types = declared.select(F.concat_ws(".", "target", "type").alias("imported"), "target").distinct()
    packages = files.select(package_name(F.col("text")).alias("target")).where("target <> ''").distinct().select(F.concat(F.col("target"), F.lit(".*")).alias("imported"), "target")
    return import_lines(files).join(types.unionByName(packages), "imported", "left")


def dependencies(resolved: DataFrame) -> DataFrame:
    """(source, target) package edges of resolved imports."""
    return resolved.where("target is not null and target <> package").select(F.col("package").alias("source"), "target").distinct()


def unresolved_count(resolved: DataFrame) -> DataFrame:
    """(imports, unresolved): single types that no file declares; unknown wildcard packages are outside and not counted."""
    return resolved.agg(F.count("*").alias("imports"), F.count_if(F.col("target").isNull() & ~F.col("imported").endswith(".*")).alias("unresolved"))


def import_evidence(files: DataFrame, packages: DataFrame) -> DataFrame:
    """(source, target, evidence): the import lines behind each edge, by file and line. An import counts for the
    longest of ``packages`` (package) that it lies in: its prefixes are exploded and meet the packages in an equi-join."""
    lines = import_lines(files).withColumn("parts", F.split(F.regexp_replace("imported", r"\.\*$", ""), r"\."))
    wildcard = F.col("imported").endswith(".*")
    depths = F.when(wildcard, F.array(F.size("parts"))).when(F.size("parts") > 1, F.sequence(F.lit(1), F.size("parts") - 1)).otherwise(F.array().cast("array<int>"))
    prefixes = lines.withColumn("n", F.explode(depths)).withColumn("target", F.array_join(F.slice("parts", F.lit(1), F.col("n")), "."))
    known = prefixes.join(packages.select(F.col("package").alias("target")).distinct(), "target", "left_semi")
    best = known.groupBy("path", "package", "line_number", "code").agg(F.max_by("target", "n").alias("target")).where("target <> package")
    record = F.array_sort(F.collect_list(F.struct("path", "line_number", "code")))
    joined = F.array_join(F.transform(record, lambda r: F.concat_ws(":", r["path"], r["line_number"].cast("string"), r["code"])), "; ")
    return best.groupBy(F.col("package").alias("source"), "target").agg(joined.alias("evidence"))


def with_results(tests: DataFrame, results: DataFrame, order: str) -> DataFrame:
    """``tests`` (class_name, method_name) with the last result of the same names, whatever their case."""
    keys = {"class_key": F.lower("class_name"), "method_key": F.lower("method_name")}
    kept = [c for c in results.columns if c not in ("class_name", "method_name", order)]
    last = results.withColumns(keys).groupBy(*keys).agg(F.max_by(F.struct(*kept), order).alias("r"))
    return tests.withColumns(keys).join(last, list(keys), "left").select(*tests.columns, *(F.col(f"r.{c}").alias(c) for c in kept))


def technology(files: DataFrame) -> DataFrame:
    """(repository, language, technology) from file names and build files of ``files`` (repository, path, text).

    The first extension of TECHNOLOGIES that occurs decides; a root build file makes Java Spring, Maven or Gradle and
    Python a project.
    """
    name = F.lower("path")
    root = ~F.contains(F.col("path"), F.lit("/"))
    pom = F.max(F.when(root & (name == "pom.xml"), F.lower(F.coalesce("text", F.lit("")))))
    found = files.groupBy("repository").agg(
        F.collect_set(F.regexp_extract(name, r"(\.[^./]+)$", 1)).alias("extensions"), pom.alias("pom"), F.max(root & name.rlike(r"\.gradle(\.kts)?$")).alias("gradle"), F.max(root & name.isin("requirements.txt", "pyproject.toml")).alias("project")
    )
    java = (
        F.when(F.contains("pom", F.lit("spring-boot")) | F.contains("pom", F.lit("springframework.boot")), "Spring Boot")
        .when(F.contains("pom", F.lit("springframework")), "Spring")
        .when(F.col("pom").isNotNull(), "Maven / Java")
        .when(F.col("gradle"), "Gradle / Java")
        .otherwise("Java")
    )
    language, kind = F.lit("Unknown"), F.lit("Unknown")
    for extension, own, what in reversed(TECHNOLOGIES):
        has = F.array_contains("extensions", extension)
        label = java if extension == ".java" else F.when(F.col("project"), "Python project").otherwise(what) if extension == ".py" else F.lit(what)
        language, kind = F.when(has, own).otherwise(language), F.when(has, label).otherwise(kind)
    return found.select("repository", language.alias("language"), kind.alias("technology"))

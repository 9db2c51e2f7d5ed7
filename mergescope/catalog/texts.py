"""Queries over source texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import views
from ..functions import quality, tables, text
from ..operators.joins import lookup_join
from ..plans import files as file_plans
from ..sources.files import decode
from .registry import query, sql_case, sql_list

NL = "chr(10)"
LINES = f"string_split(content, {NL})"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
FUNCTIONS = (
    r"\bdef\b\s+\w+\s*\(|\bfunction\b\s*\w*\s*\(|\b(void|int|float|double|char|short|long|bool|String|string)\b\s+\w+\s*\("
    r"|\bfunc\b\s+\w+\s*\(|\bfun\b\s+\w+\s*\("
)
WORDS = r"\bdef\b|\bfunction\b|\bfunc\b|\bvoid\b|\bint\b|\bString\b|\bchar\b|\bstring\b"
SHORT_WORDS = r"\bfunction\b|\bdef\b|\bclass\b|\bmethod\b"
COMMENTS = text.COMMENT_PATTERN.replace("'", "''")


def matches(pattern: str, column: str = "content") -> str:
    return f"len(regexp_extract_all({column}, '{pattern}'))"


READ_LINES = f"len({LINES}) - (content = '' OR content LIKE '%'||{NL})::INT"


@query("source_line_counts", "F5", f"""
SELECT file_id, {READ_LINES} lines_read, len({LINES}) - 1 newlines,
  {matches(BREAKS)} + (content <> '' AND NOT regexp_matches(right(content, 1), '{BREAKS}'))::INT lines_split
FROM code_files""", "code_files")
def _(spark, sf):
    c = F.col("content")
    return views.code_files(spark, sf).select(
        "file_id", text.line_count(c).alias("lines_read"), text.newline_count(c).alias("newlines"),
        text.split_line_count(c).alias("lines_split"))


@query("function_lines", "F6", f"""
SELECT file_id, len(list_filter({LINES}, lambda l: contains(l, 'def ') OR contains(l, 'function '))) n FROM code_files""", "code_files")
def _(spark, sf):
    return views.code_files(spark, sf).select("file_id", text.function_line_count(text.lines_of(F.col("content"))).alias("n"))


@query("function_patterns", "F7", f"""
SELECT file_id, {matches(FUNCTIONS)} functions, {matches(WORDS)} words,
  {matches(SHORT_WORDS)} short_words FROM code_files""", "code_files")
def _(spark, sf):
    c = F.col("content")
    return views.code_files(spark, sf).select(
        "file_id", text.function_count(c).alias("functions"), text.function_word_count(c).alias("words"),
        text.function_word_count_short(c).alias("short_words"))


@query("comment_lines", "F8", f"""
SELECT file_id, len(list_filter({LINES}, lambda l: regexp_matches(trim(l), '^(#|//)'))) n,
  len(list_filter({LINES}, lambda l: regexp_matches(trim(l), '^(#|//|/\\*)'))) with_blocks FROM code_files""", "code_files")
def _(spark, sf):
    c = F.col("content")
    return views.code_files(spark, sf).select(
        "file_id", text.comment_line_count(text.lines_of(c)).alias("n"), text.comment_line_count(text.lines_of(c), block=True).alias("with_blocks"))


@query("comment_patterns", "F9", rf"""
SELECT file_id, {matches(COMMENTS)} comments, {matches('(?s)#.*|//.*|/[*].*?[*]/')} dotall,
  {matches(r'//[^\n]*|/[*][\s\S]*?[*]/')} slashes FROM code_files""", "code_files")
def _(spark, sf):
    c = F.col("content")
    return views.code_files(spark, sf).select(
        "file_id", text.comment_count(c).alias("comments"), text.comment_count(c, dotall=True).alias("dotall"),
        text.slash_comment_count(c).alias("slashes"))


ISSUE_WORDS = [w for group in tables.ISSUE_KEYWORDS.values() for w in group]


@query("issue_lines", "F10", f"""
SELECT file_id, len(list_filter({LINES}, lambda l: {' OR '.join(f"contains(l, '{w}')" for w in ISSUE_WORDS)})) n FROM code_files""", "code_files")
def _(spark, sf):
    return views.code_files(spark, sf).select("file_id", text.issue_line_count(text.lines_of(F.col("content"))).alias("n"))


def keywords_sql(lists):
    return "CASE ext " + " ".join(f"WHEN '{e}' THEN {sql_list(w)}" for e, w in lists.items()) + " ELSE []::VARCHAR[] END"


def keyword_sum(lists):
    return f"coalesce(list_sum(list_transform({keywords_sql(lists)}, lambda k: (length(content) - length(replace(content, k, ''))) // length(k))), 0)::BIGINT"


KEYWORDS_SQL, KEYWORD_SUM = keywords_sql(tables.LANGUAGE_KEYWORDS), keyword_sum(tables.LANGUAGE_KEYWORDS)


@query("keyword_substrings", "F11 F13", f"SELECT file_id, {KEYWORD_SUM} n FROM code_files", "code_files")
def _(spark, sf):
    words = text.keywords_of(F.col("ext"))
    return views.code_files(spark, sf).select("file_id", text.substring_keyword_count(F.col("content"), words).alias("n"))


@query("python_reserved_words", "F11 F13", f"""
SELECT file_id, list_sum(list_transform({sql_list(tables.PYTHON_RESERVED)}, lambda k:
  (length(content) - length(replace(content, k, ''))) // length(k)))::BIGINT n FROM code_files WHERE ext = 'py'""", "code_files")
def _(spark, sf):
    words = F.array(*[F.lit(w) for w in tables.PYTHON_RESERVED])
    python = views.code_files(spark, sf).where(F.col("ext") == "py")
    return python.select("file_id", text.substring_keyword_count(F.col("content"), words).alias("n"))


@query("keyword_tokens", "F12", rf"""
SELECT file_id, len(list_filter(regexp_split_to_array(content, '\s+'), lambda t: list_contains({KEYWORDS_SQL}, t))) n FROM code_files""", "code_files")
def _(spark, sf):
    words = text.keywords_of(F.col("ext"))
    return views.code_files(spark, sf).select("file_id", text.token_keyword_count(F.col("content"), words).alias("n"))


@query("keyword_dictionary", "F13 J8", f"""
SELECT f.ext, keyword, count(*) files, sum((length(content) - length(replace(content, keyword, ''))) // length(keyword))::BIGINT hits
FROM code_files f JOIN (VALUES {', '.join(f"('{e}', '{w}')" for e, ws in tables.LANGUAGE_KEYWORDS.items() for w in ws)}) k(ext, keyword) ON f.ext = k.ext
GROUP BY ALL""", "code_files")
def _(spark, sf):
    # A fixed dictionary of some dozens of rows.
    joined = views.code_files(spark, sf).join(F.broadcast(text.keyword_table(spark)), "ext")
    hits = (F.octet_length("content") - F.octet_length(F.replace(F.col("content"), F.col("keyword"), F.lit("")))) / F.octet_length("keyword")
    return joined.groupBy("ext", "keyword").agg(F.count(F.lit(1)).alias("files"), F.sum(F.floor(hits)).cast("long").alias("hits"))


def has_any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


@query("multi_labels", "F14 J9 U3", f"""
SELECT file_id, coalesce(nullif(concat_ws(', ', {', '.join(f"CASE WHEN {has_any('content', w)} OR {has_any('path', w)} THEN '{k}' END" for k, w in sorted(tables.ISSUE_KEYWORDS.items()))}), ''), 'other') labels
FROM code_files""", "code_files")
def _(spark, sf):
    return views.code_files(spark, sf).select("file_id", text.multi_label(F.col("path"), F.col("content")).alias("labels"))


def label_count_sql(words: list[str], t: str = "t") -> str:
    sentence = " OR ".join(f"contains(s, '{w}')" for w in words)
    return (f"len(list_filter(regexp_extract_all({t}, '[a-z]+'), lambda w: w IN ({', '.join(repr(w) for w in words)})))"
            f" + len(list_filter(regexp_split_to_array({t}, '[.!?\\n]'), lambda s: {sentence}))")


def label_sql(counts: dict[str, str], default: str) -> str:
    best = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {best} = 0 THEN {default} " + " ".join(f"WHEN {c} = {best} THEN '{k}'" for k, c in counts.items()) + " END"


COUNT_COLUMNS = ", ".join(f"{label_count_sql(w)} AS {k}" for k, w in tables.LABEL_KEYWORDS.items())
LABEL = label_sql({k: k for k in tables.LABEL_KEYWORDS}, "'other'")
FILE_LABELS = f"SELECT file_id, {LABEL} AS label FROM (SELECT file_id, {COUNT_COLUMNS} FROM (SELECT file_id, lower(path||' '||content) t FROM code_files))"


@query("issue_labels", "F15 A22", FILE_LABELS, "code_files")
def _(spark, sf):
    return text.with_label(views.code_files(spark, sf), "path", "content").select("file_id", "label")


TOKEN_COUNTS = ", ".join(
    f"len(list_filter(regexp_extract_all(t, '[a-z]+'), lambda w: {' OR '.join(f'''contains(w, '{x}')''' for x in w_)})) AS {k}"
    for k, w_ in tables.LABEL_KEYWORDS.items())


@query("token_labels", "F16", f"""
SELECT file_id, {label_sql({k: k for k in tables.LABEL_KEYWORDS}, 'NULL')} AS label FROM
 (SELECT file_id, {TOKEN_COUNTS} FROM (SELECT file_id, lower(path||' '||content) t FROM code_files))""", "code_files")
def _(spark, sf):
    return text.with_label(views.code_files(spark, sf), "path", "content", contains=True).select("file_id", "label")


@query("text_chunks", "F17", """
SELECT file_id, i AS chunk, length(substr(content, i * 2000 + 1, 2000)) n_chars, md5(substr(content, i * 2000 + 1, 2000)) digest
FROM (SELECT file_id, content, unnest(generate_series(0, ceil(length(content) / 2000)::BIGINT - 1)) i FROM code_files)""", "code_files")
def _(spark, sf):
    # The pieces are smaller than the default so that the tables' texts fall into several.
    pieces = views.code_files(spark, sf).select("file_id", F.posexplode(text.chunks(F.col("content"), 2000)).alias("chunk", "piece"))
    return pieces.select("file_id", "chunk", F.length("piece").alias("n_chars"), F.md5(F.col("piece").cast("binary")).alias("digest"))


LANG = sql_case("ext", tables.DETECTED_LANGUAGE)


def long_lines_sql() -> str:
    limit = "CASE language " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in tables.LINE_LIMITS.items()) + f" ELSE {tables.DEFAULT_LINE_LIMIT} END"
    return f"len(list_filter({LINES}, lambda l: length(l) > {limit}))", limit


LONG, LIMIT = long_lines_sql()
SLASHED = f"language IN ({', '.join(repr(x) for x in tables.SLASH_COMMENT_LANGUAGES)})"
CODE_WORDS = "|".join(tables.CODE_WORDS)
HASHED = rf"regexp_matches(content, '#[^\n]*\b({CODE_WORDS})\b')"
NEWER = rf"CASE WHEN {SLASHED} THEN contains(content, '//') OR contains(content, '/*') OR regexp_matches(content, '[*]/[^\n]*\b({CODE_WORDS})\b') ELSE {HASHED} END"
OLDER = rf"""CASE language WHEN 'Python' THEN regexp_matches(content, '#[^\n]*\b(if|for|while|return|class|def)\b')
  WHEN 'Ruby' THEN contains(content, '# ') ELSE contains(content, '/*') OR contains(content, '*/') END"""
DEBUG = "CASE " + " ".join(
    f"WHEN language = '{k}' AND contains(content, '{m}') THEN '{t}'" for k, (m, t) in tables.DEBUG_PRINTS.items()) + " END"


def issues_sql(rule: str) -> str:
    return f"""coalesce(nullif(concat_ws({NL}, {DEBUG}, CASE WHEN {rule} THEN '{tables.COMMENTED_CODE_MESSAGE}' END,
      CASE WHEN {LONG} > 0 THEN {LONG}||' lines exceed '||{LIMIT}||' characters.' END), ''), '{tables.NO_ISSUES_MESSAGE}')"""


NAMED = f"(SELECT *, {LANG} AS language FROM code_files)"


@query("quality_issues", "F19 F20 F21 F22", f"SELECT file_id, language, {issues_sql(NEWER)} AS issues FROM {NAMED} WHERE language IS NOT NULL", "code_files")
def _(spark, sf):
    files = views.code_files(spark, sf).withColumn("language", text.language_of(F.col("path"))).where(F.col("language").isNotNull())
    return quality.with_issues(files).select("file_id", "language", F.array_join("issues", "\n").alias("issues"))


@query("quality_issues_older_rules", "F19 F20 F21 F22", f"SELECT file_id, {issues_sql(OLDER)} AS issues FROM {NAMED} WHERE language IS NOT NULL", "code_files")
def _(spark, sf):
    files = views.code_files(spark, sf).withColumn("language", text.language_of(F.col("path"))).where(F.col("language").isNotNull())
    return quality.with_issues(files, older=True).select("file_id", F.array_join("issues", "\n").alias("issues"))


@query("long_lines", "F21", f"SELECT file_id, {LONG} n, {LIMIT} AS line_limit FROM {NAMED}", "code_files")
def _(spark, sf):
    files = views.code_files(spark, sf).withColumn("language", text.language_of(F.col("path")))
    language = F.coalesce("language", F.lit(""))
    return files.select("file_id", quality.long_line_count(F.col("content"), language).alias("n"), quality.line_limit(language).alias("line_limit"))


@query("import_counts", "F29", rf"""
SELECT file_id, len(list_filter({LINES}, lambda l: regexp_matches(l, '^[ \t]*(import|from)[ \t]'))) n FROM code_files WHERE ext = 'py'""", "code_files")
def _(spark, sf):
    return views.code_files(spark, sf).where(F.col("ext") == "py").select("file_id", text.import_count(F.col("content")).alias("n"))


COMPLEXITY = rf"""CASE WHEN len(regexp_extract_all(content, '(^|\n)[ \t]*def[ \t]+\w+')) = 0 THEN 0.0 ELSE
  1.0 + len(regexp_extract_all(regexp_extract(content, '(?s)(^|\n)[ \t]*def[ \t]+\w+.*'), '\b(if|elif|for|while|except|and|or|assert)\b'))::DOUBLE
  / len(regexp_extract_all(content, '(^|\n)[ \t]*def[ \t]+\w+')) END"""


@query("cyclomatic_complexity", "F30", f"SELECT file_id, round({COMPLEXITY}, 8) score FROM code_files WHERE ext = 'py'", "code_files")
def _(spark, sf):
    python = views.code_files(spark, sf).where(F.col("ext") == "py")
    return python.select("file_id", F.round(text.cyclomatic_complexity(F.col("content")), 8).alias("score"))


@query("function_names", "F31", r"""
SELECT file_id, array_to_string(regexp_extract_all(content, '\b(def|function|func|fun)[ \t]+(\w+)[ \t]*\(', 2), ',') AS names,
  array_to_string(regexp_extract_all(content, '\b(public|private|protected|static|void|int|long|double|boolean|String)[ \t]+(\w+)[ \t]*\(', 2), ',') AS methods
FROM code_files""", "code_files")
def _(spark, sf):
    c = F.col("content")
    return views.code_files(spark, sf).select(
        "file_id", F.array_join(text.function_names(c), ",").alias("names"), F.array_join(text.method_names(c), ",").alias("methods"))


@query("python_functions_and_docstrings", "F32", r"""
SELECT file_id, len(list_filter(string_split(content, chr(10)), lambda l: regexp_matches(l, '^[ \t]*def[ \t]+\w+'))) functions,
  len(regexp_extract_all(content, '(^|\n)[ \t]*("{3}[\s\S]*?"{3}|''{3}[\s\S]*?''{3})')) docstrings FROM code_files""", "code_files")
def _(spark, sf):
    c = F.col("content")
    return views.code_files(spark, sf).select(
        "file_id", text.python_function_count(c).alias("functions"), text.docstring_count(c).alias("docstrings"))


@query("languages", "F2 F3 F4 J8", f"""
SELECT file_id, ext, {LANG} AS language, {sql_case('ext', tables.LANGUAGE_FAMILY)} AS family,
  coalesce({sql_case('ext', tables.EXTENSION_LANGUAGE)}, 'Unknown') AS known,
  coalesce('.'||{sql_case(LANG, {v: k for k, v in tables.EXTENSION_LANGUAGE.items()})}, 'Unknown language') AS language_ext,
  {sql_case('ext', tables.FAMILY_EXTENSION)} AS family_ext FROM code_files""", "code_files")
def _(spark, sf):
    path = F.col("path")
    language = text.language_of(path)
    return views.code_files(spark, sf).select(
        "file_id", text.extension(path).alias("ext"), language.alias("language"),
        text.language_of(path, tables.LANGUAGE_FAMILY).alias("family"), text.language_or_unknown(text.extension(path)).alias("known"),
        text.extension_of_language(language).alias("language_ext"), text.family_extension(path).alias("family_ext"))


@query("page_paths", "F2 F33", """
SELECT page_id, split_part(path, '/', 1) AS owner, split_part(path, '/', 2) AS name,
  list_last(string_split(path, '.')) AS ext FROM
 (SELECT page_id, regexp_replace(split_part(split_part(url, '#', 1), '?', 1), '^https?://', '') path FROM pages)""")
def _(spark, sf):
    path = F.col("path")
    return views.pull_paths(spark, sf).select(
        "page_id", text.repository_owner(path).alias("owner"), text.repository_short_name(path).alias("name"), text.extension(path).alias("ext"))


@query("decoded_files", "S7 F28", """
SELECT doc_id file_id, CASE WHEN doc_id % 4 = 0 THEN base64(encode(text)) ELSE text END AS content,
  CASE doc_id % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'Python' WHEN 2 THEN 'Kotlin' ELSE 'Unknown' END AS language FROM documents""")
def _(spark, sf):
    exts = F.array(F.lit("class"), F.lit("PY"), F.lit("kt"), F.lit("dat"))
    raw = views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("file_id"), F.get(exts, (F.col("doc_id") % 4).cast("int")).alias("ext"), F.col("text").cast("binary").alias("bytes"))
    return decode(raw).select("file_id", "content", "language")


BASE_FEATURES = f"""path, repository, len({LINES}) - 1 num_lines, {matches(FUNCTIONS)} num_functions, {matches(COMMENTS)} num_comments,
  {keyword_sum(tables.LONG_KEYWORDS)} num_keywords"""


@query("file_features", "Q3 F13 A14", f"""
SELECT {BASE_FEATURES}, CASE WHEN ext IN ('py', 'java', 'js', 'ts', 'php', 'cpp') THEN file_id % 12 % 4 END num_errors,
  CASE WHEN ext IN ('py', 'java', 'php') THEN file_id % 12 % 3 WHEN ext IN ('js', 'ts') THEN file_id % 12 % 3 + 1 WHEN ext = 'cpp' THEN 0 END num_warnings,
  CASE WHEN ext = 'go' THEN file_id % 12 % 4 END num_issues, label AS labels
FROM code_files JOIN ({FILE_LABELS}) USING (file_id)""", "code_files")
def _(spark, sf):
    files = views.code_files(spark, sf).withColumn("lint_output", views.lint_output(F.col("ext"), (F.col("file_id") % 12).cast("int")))
    return file_plans.file_features(files, tables.LONG_KEYWORDS, "lint_output")


@query("short_file_features", "Q3", f"""
SELECT path, repository, len({LINES}) - 1 num_lines, {matches(WORDS)} num_functions,
  {matches('(?s)#.*|//.*|/[*].*?[*]/')} num_comments, {KEYWORD_SUM} num_keywords, label AS labels
FROM code_files JOIN ({FILE_LABELS}) USING (file_id)""", "code_files")
def _(spark, sf):
    return file_plans.short_file_features(views.code_files(spark, sf))


@query("line_features", "F5 F6 F8 F10 F14 F29 F30 P6", rf"""
SELECT path, repository, {READ_LINES} num_lines,
  len(list_filter({LINES}, lambda l: contains(l, 'def ') OR contains(l, 'function '))) num_functions,
  len(list_filter({LINES}, lambda l: regexp_matches(trim(l), '^(#|//)'))) num_comments,
  len(list_filter({LINES}, lambda l: {' OR '.join(f"contains(l, '{w}')" for w in ISSUE_WORDS)})) num_keywords,
  CASE WHEN ext = 'py' THEN round({COMPLEXITY}, 8) END cyclomatic_complexity,
  CASE WHEN ext = 'py' THEN len(list_filter({LINES}, lambda l: regexp_matches(l, '^[ \t]*(import|from)[ \t]'))) END num_imports,
  coalesce(nullif(concat_ws(', ', {', '.join(f"CASE WHEN {has_any('content', w)} OR {has_any('path', w)} THEN '{k}' END" for k, w in sorted(tables.ISSUE_KEYWORDS.items()))}), ''), 'other') labels
FROM code_files WHERE ext IN ({', '.join(repr(e) for e in tables.SOURCE_EXTENSIONS)})""", "code_files")
def _(spark, sf):
    features = file_plans.line_features(views.code_files(spark, sf))
    return features.withColumn("cyclomatic_complexity", F.round("cyclomatic_complexity", 8))


SECURITY = f"""SELECT file_id, (count(*) FILTER (WHERE type = 'error'))||' errors, '||(count(*) FILTER (WHERE type = 'warning'))||' warnings' AS security
  FROM findings WHERE type IN ('error', 'warning') GROUP BY file_id"""


@query("file_security_table", "Q4 P14 F36", f"""
SELECT repository repo_name, pr_id pr_number, path AS file, language,
  CASE WHEN language IN ({', '.join(repr(x) for x in tables.SECURITY_LANGUAGES)}) THEN security END security_analysis
FROM files JOIN {NAMED} USING (file_id) LEFT JOIN ({SECURITY}) USING (file_id) WHERE language IS NOT NULL""", "code_files files findings")
def _(spark, sf):
    from ..plans.pulls import security_hits

    return file_plans.security_table(views.files(spark, sf), security_hits(views.findings(spark, sf)), views.code_files(spark, sf))


PULL_LABELS = f"SELECT pr_id, {LABEL} AS label FROM (SELECT pr_id, {COUNT_COLUMNS} FROM (SELECT pr_id, lower(title||' '||coalesce(body, '')) t FROM pulls))"


@query("pull_file_features", "Q5", rf"""
SELECT pr_id, position.line, position.part, position.supplier, loc, comments, functions, language_keywords_count, label FROM files JOIN
 (SELECT file_id, {matches(BREAKS)} + (content <> '' AND NOT regexp_matches(right(content, 1), '{BREAKS}'))::INT loc,
  CASE WHEN ext = 'py' THEN len(regexp_extract_all(content, '(^|\n)[ \t]*("{{3}}[\s\S]*?"{{3}}|''{{3}}[\s\S]*?''{{3}})')) ELSE {matches(r'//[^\n]*|/[*][\s\S]*?[*]/')} END AS comments,
  CASE WHEN ext = 'py' THEN len(list_filter({LINES}, lambda l: regexp_matches(l, '^[ \t]*def[ \t]+\w+'))) ELSE {matches(SHORT_WORDS)} END functions,
  len(list_filter(regexp_split_to_array(content, '\s+'), lambda t: list_contains({KEYWORDS_SQL}, t))) language_keywords_count
  FROM code_files WHERE ext IN ({', '.join(repr(e) for e in tables.LANGUAGE_KEYWORDS)})) USING (file_id)
 JOIN ({PULL_LABELS}) USING (pr_id)""", "code_files files pulls")
def _(spark, sf):
    df = file_plans.pull_file_features(views.files(spark, sf), views.code_files(spark, sf), views.pulls(spark, sf))
    return df.select("pr_id", "position.*", *df.columns[2:])

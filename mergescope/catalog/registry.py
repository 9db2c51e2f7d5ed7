"""Registration of queries and the SQL views their checks share."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import views
from ..functions import tables

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Query
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None, using: str = "") -> Callable[[Query], Query]:
    """Register a query. ``using`` names the views its SQL needs, in order."""

    def add(run: Query) -> Query:
        full = sql
        if sql is not None and using:
            parts = [f"{view} AS ({VIEWS[view]})" for view in using.split()]
            full = "WITH " + ",\n".join(parts) + "\n" + sql.lstrip()
        ENTRIES[name] = Entry(name, covers, run, full)
        return run

    return add


def sql_list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _sql_text(text: str) -> str:
    return "'" + text.replace("\n", "'||chr(10)||'") + "'"


def _code_text() -> str:
    column = "text"
    for old, new in views.CODE_REPLACEMENTS:
        column = f"replace({column}, {_sql_text(old)}, {_sql_text(new)})"
    return column


def sql_case(key: str, mapping: dict[str, str], default: str = "NULL") -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE {key} {cases} ELSE {default} END"


EXT = f"{sql_list(views.EXTENSIONS)}[(doc_id % {len(views.EXTENSIONS)} + 1)::INT]"
HASH = "('0x'||substr(md5(%s), 1, 8))::BIGINT"

VIEWS = {
    "pulls": """SELECT o_orderkey pr_id, o_custkey author, o_orderpriority repository_name,
        o_orderpriority||' #'||o_orderkey title,
        CASE WHEN o_orderkey % 3 <> 0 THEN 'Change '||floor(o_totalprice)::BIGINT END body,
        o_orderdate created_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(floor(o_totalprice)::BIGINT) END merged_at,
        o_orderstatus = 'F' merged, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'closed' END state,
        floor(o_totalprice)::BIGINT % 20 commits, o_custkey % 5 comments, o_orderkey % 4 review_comments FROM orders""",
    "reviews": """SELECT l_orderkey pr_id, l_suppkey reviewer, CASE WHEN l_tax > 0 THEN l_shipdate END submitted_at,
        CASE l_returnflag WHEN 'A' THEN 'APPROVED' WHEN 'N' THEN 'COMMENTED' WHEN 'R' THEN 'CHANGES_REQUESTED' END state
        FROM lineitem""",
    "files": """SELECT l_orderkey pr_id, struct_pack(line := l_linenumber, part := l_partkey, supplier := l_suppkey) AS position,
        l_partkey file_id, l_quantity::BIGINT additions, round(l_tax * 100)::BIGINT deletions FROM lineitem""",
    "authors": """SELECT c_custkey author, floor(c_acctbal)::BIGINT contributions,
        TIMESTAMP '1995-01-01' - to_seconds((c_custkey % 1825) * 86400 + c_custkey % 7 * 3600) joined_at FROM customer""",
    "commits": "SELECT o_orderpriority repository_name, o_custkey author, o_orderkey commit_id FROM orders",
    "pull_labels": "SELECT event_id pr_id, CASE event_type WHEN 'error' THEN 'bug' ELSE event_type END AS name FROM events",
    "comments": "SELECT conv_id pr_id, turn AS position, text body FROM conversations",
    "code_files": f"""SELECT doc_id file_id, source repository, {EXT} ext,
        source||'/file_'||doc_id||'.'||{EXT} path, {_code_text()} AS content FROM documents""",
    "findings": f"""SELECT event_id, user_id file_id, {sql_case('event_type', views.FINDING_TYPES)} AS type,
        (props->>'$.k')::INT k FROM events""",
    "function_rows": """SELECT l_partkey file_id, l_quantity nloc, l_linenumber * 3 ccn,
        floor(l_extendedprice / 100) tokens FROM lineitem""",
    "lexicon": """SELECT DISTINCT word, (length(word) % 9 - 4) / 4.0::DOUBLE polarity FROM
        (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) word FROM benchmark)""",
    "scored": """SELECT (l_returnflag = 'R')::INT y, score, (score >= 0.5)::INT prediction FROM
        (SELECT l_returnflag, (floor(l_extendedprice) + round(l_discount * 100) * 5000) / 155000.0::DOUBLE score FROM lineitem)""",
    "scored_multi": """SELECT y, a / (a + n + r) p0, n / (a + n + r) p1, r / (a + n + r) p2,
        CASE WHEN a >= n AND a >= r THEN 0 WHEN n >= r THEN 1 ELSE 2 END prediction FROM
        (SELECT CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END y, l_quantity a,
         l_linenumber * 7.0::DOUBLE n, round(l_tax * 100) * 6 r FROM lineitem)""",
    "regressed": """SELECT l_orderkey pr_id, l_linenumber AS position, l_partkey file_id, l_suppkey reviewer,
        l_extendedprice / 1000 y, l_quantity * 1.5::DOUBLE + l_discount * 100 prediction FROM lineitem""",
    "labelled": """SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "documents_nested": f"""SELECT doc_id number, source repository_name, n_chars n, lang, text,
        split_part(text, chr(10), 1) title, CASE WHEN doc_id % 5 <> 0 THEN text END body FROM documents""",
    # Size metrics of each file from its functions.
    "sizes": """SELECT file_id, sum(nloc) nloc, sum(nloc) / count(*) avg_nloc, sum(ccn)::DOUBLE / count(*) avg_ccn,
        sum(tokens) / count(*) avg_token, count(*)::DOUBLE fun_cnt,
        (count(*) FILTER (WHERE ccn > 15 OR nloc > 1000))::DOUBLE warning_cnt,
        (count(*) FILTER (WHERE ccn > 15 OR nloc > 1000))::DOUBLE / count(*) fun_rt,
        coalesce(sum(nloc) FILTER (WHERE ccn > 15 OR nloc > 1000), 0) / sum(nloc) nloc_rt
        FROM function_rows GROUP BY file_id""",
}


def rating_sql(use_ccn: bool = False) -> str:
    """Scores as a list in order of strictness; the position of the first maximum names the rating."""
    scored = [m for m in tables.METRICS if use_ccn or m != "avg_ccn"]
    order = sorted(tables.RATING_THRESHOLDS, key=lambda r: tables.RATING_THRESHOLDS[r][0])
    sums = []
    for name in order:
        limits = dict(zip(tables.METRICS, tables.RATING_THRESHOLDS[name]))
        sums.append(" + ".join(f"({m} <= {limits[m]}::DOUBLE * 1.1::DOUBLE)::INT" for m in scored))
    scores = "[" + ", ".join(sums) + "]"
    return f"{sql_list(order)}[list_position({scores}, list_max({scores}))]"


VIEWS["ratings"] = f"SELECT file_id, {rating_sql()} AS rating FROM sizes"

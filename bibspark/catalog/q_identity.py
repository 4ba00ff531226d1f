"""Author identity over three feeds: ids of suppliers that differ by feed and part of the catalogue."""

from pyspark.sql import functions as F

from bibspark.catalog.registry import query
from bibspark.operators import identity, metrics

# Lines as author rows of three feeds; each has its own ids and its own way with names.
FEED_ROWS_SQL = """
  SELECT 'P' || CAST(l_partkey AS VARCHAR) AS paper_id,
         CASE l_returnflag WHEN 'A' THEN 'S' || CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_partkey % 300 AS VARCHAR)
              WHEN 'R' THEN 'oa_' || CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_partkey % 200 AS VARCHAR)
              ELSE 'cr_' || CAST(l_suppkey AS VARCHAR) || '_' || CAST(l_orderkey % 200 AS VARCHAR) END AS author_id,
         CASE l_returnflag WHEN 'A' THEN given || ' ' || family WHEN 'R' THEN family || ', ' || given
              ELSE upper(given) || ' ' || upper(family) END AS author_name
  FROM (SELECT *, 'Given' || CAST(l_suppkey % 7 AS VARCHAR) AS given, 'Family' || CAST(l_suppkey % 90 AS VARCHAR) AS family
        FROM lineitem)"""

PERSONS_SQL = f"""
WITH RECURSIVE feed_rows AS ({FEED_ROWS_SQL}),
blocks AS (SELECT DISTINCT paper_id, author_id,
             array_to_string(list_sort(list_filter(string_split_regex(lower(author_name), '[^a-z0-9]+'),
                                                   lambda x: x <> '')), ' ') AS name FROM feed_rows),
links AS (SELECT DISTINCT x.author_id AS a, y.author_id AS b
          FROM blocks x JOIN blocks y ON x.paper_id = y.paper_id AND x.name = y.name AND x.author_id <> y.author_id),
reach AS (SELECT DISTINCT author_id, author_id AS other FROM feed_rows
          UNION SELECT r.author_id, l.b FROM reach r JOIN links l ON r.other = l.a),
persons AS (SELECT author_id, min(other) AS person_id FROM reach GROUP BY author_id)
"""


def feed_rows(t):
    text = {c: F.col(c).cast("string") for c in ("l_partkey", "l_suppkey")}
    given = F.concat(F.lit("Given"), (F.col("l_suppkey") % 7).cast("string"))
    family = F.concat(F.lit("Family"), (F.col("l_suppkey") % 90).cast("string"))

    def own(prefix, number):
        return F.concat(F.lit(prefix), text["l_suppkey"], F.lit("_"), number.cast("string"))

    flag = F.col("l_returnflag")
    return t.lineitem.select(
        F.concat(F.lit("P"), text["l_partkey"]).alias("paper_id"),
        F.when(flag == "A", own("S", F.col("l_partkey") % 300))
        .when(flag == "R", own("oa_", F.col("l_partkey") % 200))
        .otherwise(own("cr_", F.col("l_orderkey") % 200))
        .alias("author_id"),
        F.when(flag == "A", F.concat_ws(" ", given, family))
        .when(flag == "R", F.concat_ws(", ", family, given))
        .otherwise(F.concat_ws(" ", F.upper(given), F.upper(family)))
        .alias("author_name"),
    )


@query("author_identity", "", PERSONS_SQL + "SELECT author_id, person_id FROM persons")
def author_identity(t):
    return identity.persons(feed_rows(t))


@query(
    "person_report",
    "",
    PERSONS_SQL
    + """
SELECT person_id, count(DISTINCT author_id) AS ids, count(DISTINCT paper_id) AS papers, min(author_name) AS name
FROM feed_rows JOIN persons USING (author_id) GROUP BY person_id""",
)
def person_report(t):
    rows = feed_rows(t)
    return identity.person_report(rows, identity.persons(rows))


@query(
    "person_coauthors",
    "",
    PERSONS_SQL
    + """
SELECT paper_id, count(DISTINCT person_id) AS a_i FROM feed_rows JOIN persons USING (author_id) GROUP BY paper_id""",
)
def person_coauthors(t):
    rows = feed_rows(t)
    return metrics.coauthor_count(identity.with_persons(rows, identity.persons(rows)))

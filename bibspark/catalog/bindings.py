"""The bibliographic tables as views over the driver tables.

Views that many queries start from are landed: written once per session to the
shared folder and read back, as the index and graph jobs do. `Tables` builds each view as a DataFrame; `CTES` states the same view in SQL.
Documents are papers of the index (feeds, topics, authors). Parts are papers of
the citation graph: the largest part of an order cites the other parts of the
order. Every document, part, order and line is read; a line that holds its order's largest
part itself gives no citation, as papers do not cite themselves.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.catalog import payloads
from bibspark.operators import clean, features, graph, metrics, search
from bibspark.session import new_path, stamp
from bibspark.skew import find_hot, spread_join
from bibspark.sources import tables

# The seed layer: parts of this type. Seeds of size 50 have no metadata row.
SEED_TYPE = "ECONOMY"
LAMBDA = 0.1


# (application, directory, its files, view) -> path and schema of the landed table.
_LANDED: dict[tuple[str, str, str, str], tuple] = {}


def landed(build=None, by: str | None = None):
    """A view written once per session and input folder, in folders by the column `by` if there is one."""
    if build is None:
        return lambda fn: landed(fn, by)

    def read(self: Tables) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.dir, self.files, build.__name__)
        if key not in _LANDED:
            df = build(self)
            path = new_path(self.spark, build.__name__)
            if by is None:
                df.write.parquet(path)
            else:
                tables.write_partitioned(df, path, by)
            _LANDED[key] = (path, df.schema)
        path, schema = _LANDED[key]
        return self.spark.read.schema(schema).parquet(path)

    return property(read)


def with_lead(lines: DataFrame) -> DataFrame:
    """Order lines with `lead`, the order's largest part; lines without an order are dropped."""
    hot = find_hot(lines, "l_orderkey")
    if hot["l_orderkey"] is None:
        # an order fits a task: one exchange brings its lines and their largest part together
        order = Window.partitionBy("l_orderkey")
        return lines.where("l_orderkey is not null").withColumn("lead", F.max("l_partkey").over(order))
    lead = lines.groupBy("l_orderkey").agg(F.max("l_partkey").alias("lead"))
    return spread_join(lines, lead, "l_orderkey", hot=hot)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    @cached_property
    def files(self) -> str:
        """What tells this folder's tables from those of an earlier state."""
        return stamp(self.spark, self.dir)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # ---- documents as papers ---------------------------------------------
    @cached_property
    def raw_docs(self) -> DataFrame:
        """(doc_id, title, abstract, names, year, source): unjoined, with gaps."""
        labelled = self.documents.join(self.labels, "doc_id", "left")
        names = F.array(
            F.concat(F.lit("A"), (F.col("n_chars") % 97).cast("string")),
            F.concat(F.lit("A"), (F.col("doc_id") % 89).cast("string")),
            F.concat_ws(" ", "source", "lang"),
        )
        return labelled.select(
            "doc_id",
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.when(F.coalesce("quality", F.lit(1)) != 0, F.col("text")).alias("abstract"),
            F.when(F.coalesce("toxic", F.lit(0)) == 1, F.array().cast("array<string>"))
            .otherwise(names)
            .alias("authors"),
            (F.lit(2000) + F.col("doc_id") % 25).cast("int").alias("year"),
            F.when(F.col("lang") == "en", "arxiv").otherwise("s2orc").alias("source"),
        )

    @cached_property
    def raw_papers(self) -> DataFrame:
        return self.raw_docs.drop("doc_id")

    @landed
    def papers(self) -> DataFrame:
        valid = clean.valid_papers(self.raw_docs)
        return clean.final_layout(clean.dedup_papers(clean.normalise(valid), ["doc_id"]))

    @property
    def search_index(self) -> str:
        """Folder of the posting index over the papers' abstracts, built once per session."""
        key = (self.spark.sparkContext.applicationId, self.dir, self.files, "search_index")
        if key not in _LANDED:
            path = new_path(self.spark, "search_index")
            search.build(self.papers, path)
            _LANDED[key] = (path,)
        return _LANDED[key][0]

    @landed
    def inverted(self) -> DataFrame:
        return payloads.inverted_docs(self)

    # ---- orders as papers with suppliers as authors ------------------------
    @landed
    def authorship(self) -> DataFrame:
        """(paper_id, author, year), one row per line: an author may repeat."""
        lines = self.lineitem.select("l_orderkey", F.col("l_suppkey").alias("s_suppkey"))
        named = lines.join(self.supplier.select("s_suppkey", "s_name"), "s_suppkey")
        years = self.orders.select(
            F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year")
        )
        return spread_join(named, years, "l_orderkey").select(
            F.col("l_orderkey").cast("string").alias("paper_id"), F.col("s_name").alias("author"), "year"
        )

    # ---- parts as papers of the citation graph -----------------------------
    @cached_property
    def nodes(self) -> DataFrame:
        return self.part.select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("paper_id"),
            F.when(F.col("p_size") != 21, F.col("p_name")).alias("title"),
            F.when(
                ~F.col("p_size").isin(7, 21), F.concat_ws(" ", "p_name", "p_type", "p_brand")
            ).alias("abstract"),
            F.when(F.col("p_size") != 13, F.lit(1974) + F.col("p_size")).cast("int").alias("year"),
            "p_type",
            "p_size",
            "p_brand",
        )

    @landed
    def cite_rows(self) -> DataFrame:
        """One row per citing line, duplicates included."""
        lines = self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus",
            "l_quantity", "l_discount",
        )
        return (
            with_lead(lines)
            .where(F.col("l_partkey") < F.col("lead"))
            .select(
                F.concat(F.lit("P"), F.col("lead").cast("string")).alias("citing_id"),
                F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("cited_id"),
                (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
                F.when(F.col("l_quantity") == 1, None)
                .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "method")
                .when(F.col("l_returnflag") == "A", "Method")
                .when(F.col("l_returnflag") == "R", "result")
                .when(F.col("l_linestatus") == "O", "background")
                .otherwise("unknown")
                .alias("label"),
                F.when(
                    F.abs("l_discount") > 0,
                    F.concat(
                        F.lit("line "), F.col("l_linestatus"), F.lit(" of "),
                        F.col("l_quantity").cast("int").cast("string"),
                    ),
                ).alias("context"),
                "l_returnflag",
                "l_linestatus",
                "l_quantity",
                F.abs("l_discount").alias("l_discount"),
            )
        )

    @landed
    def cites(self) -> DataFrame:
        """Distinct edges with intent, importance, key flag and years apart."""
        rows = self.cite_rows
        # rows of the written table are counted: there are no more edges than rows
        hot = find_hot(rows, "citing_id", "cited_id")
        if hot["citing_id"] is None:
            # one exchange serves the aggregation and the join to the citing year
            rows = rows.repartition("citing_id")
        edges = rows.groupBy("citing_id", "cited_id").agg(
            F.min("l_returnflag").alias("flag"),
            F.min("l_discount").alias("discount"),
            F.min("l_quantity").alias("quantity"),
            F.min("context").alias("context"),
        )
        years = self.nodes.select("paper_id", "year")
        edges = graph.with_years(edges, years, "citing_id", "cited_id", hot=hot)
        return edges.select(
            "citing_id",
            "cited_id",
            F.when(F.col("flag") == "A", "Method").when(F.col("flag") == "R", "Result")
            .otherwise("Background").alias("intent"),
            (F.col("discount") * 10).alias("importance"),
            (F.col("quantity") > 25).alias("is_key"),
            "context",
            "citing_year",
            "cited_year",
            graph.delta_t_scaled(F.col("citing_year"), F.col("cited_year")).alias("delta_t"),
        )

    @landed(by="bucket")
    def adjacency(self) -> DataFrame:
        """Who cites a paper, in folders by bucket."""
        return graph.adjacency(self.cites)

    @cached_property
    def weighted(self) -> DataFrame:
        return metrics.weigh_edges(self.cites, LAMBDA)

    @cached_property
    def predictions(self) -> DataFrame:
        """Edge predictions: importance taken as the learned weight."""
        return self.cites.withColumn("semantic_weight", F.col("importance"))

    @landed
    def writes(self) -> DataFrame:
        """Authors of a part: its brand, its type, and every supplier that shipped it twice."""
        part = self.part.select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("paper_id"),
            F.explode(F.array("p_brand", "p_type")).alias("author_id"),
        )
        shipped = (
            self.lineitem.groupBy("l_suppkey", "l_partkey")
            .agg(F.count(F.lit(1)).alias("n"))
            .where("n >= 2")
            .select(
                F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("paper_id"),
                F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("author_id"),
            )
        )
        return part.unionByName(shipped).select("author_id", "paper_id")

    @cached_property
    def seeds_meta(self) -> DataFrame:
        """Raw seed table: padded ids, some seeds absent, authors as one string."""
        return self.nodes.where((F.col("p_type") == SEED_TYPE) & (F.col("p_size") != 50)).select(
            F.concat(F.lit("\t"), F.col("paper_id"), F.lit(" ")).alias("source_paper_id"),
            "title",
            "abstract",
            "year",
            F.concat_ws(" , ", "p_brand", "p_type").alias("authors"),
        )

    @landed
    def _hop_rows(self) -> DataFrame:
        cited = self.nodes.select(F.col("paper_id").alias("cited_id"), F.col("p_type").alias("cited_type"))
        citing = self.nodes.select(
            F.col("paper_id").alias("citing_id"), "title", "abstract", "year",
            F.col("p_brand").alias("brand"),
        )
        rows = self.cite_rows.select("citing_id", "cited_id", "seq", "label", "context", "l_linestatus")
        hot = find_hot(rows, "cited_id", "citing_id")
        return spread_join(spread_join(rows, cited, "cited_id", hot=hot), citing, "citing_id", hot=hot)

    @cached_property
    def hop1(self) -> DataFrame:
        """Raw first layer: lines citing a seed, ids padded on some rows."""
        pad = F.when(F.col("l_linestatus") == "F", F.lit(" \n")).otherwise("")
        return self._hop_rows.where(F.col("cited_type") == SEED_TYPE).select(
            F.concat("citing_id", pad).alias("hop1_id"),
            F.concat(pad, "cited_id").alias("hop0_id"),
            F.col("title").alias("hop1_title"),
            F.col("abstract").alias("hop1_abstract"),
            F.col("year").alias("hop1_year"),
            F.col("label").alias("intent_label"),
            F.col("context").alias("citation_text"),
            "seq",
        )

    @cached_property
    def hop2(self) -> DataFrame:
        """Raw second layer: all other lines, and open lines citing a seed once more."""
        return self._hop_rows.where(
            (F.col("cited_type") != SEED_TYPE) | (F.col("l_linestatus") == "O")
        ).select(
            F.col("citing_id").alias("hop2_id"),
            F.col("cited_id").alias("hop1_id"),
            F.col("title").alias("hop2_title"),
            F.col("abstract").alias("hop2_abstract"),
            F.col("year").alias("hop2_year"),
            F.col("context").alias("citation_text"),
            "seq",
        )

    @cached_property
    def _cleaned(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return clean.clean_layers(self.seeds_meta, self.hop1, self.hop2, ["seq"])

    @landed
    def clean0(self) -> DataFrame:
        return self._cleaned[0]

    @landed
    def clean1(self) -> DataFrame:
        return self._cleaned[1]

    @landed
    def clean2(self) -> DataFrame:
        return self._cleaned[2]

    @cached_property
    def cleaned(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.clean0, self.clean1, self.clean2

    def _imputed(self) -> tuple:
        h0, h1, h2 = self.cleaned
        mid = clean.median_year(h0.select("year"), h1.select("hop1_year"), h2.select("hop2_year"))
        mid = mid.scalar()
        return (
            clean.impute_missing(h0, "abstract", "title", "year", mid),
            clean.impute_missing(h1, "hop1_abstract", "hop1_title", "hop1_year", mid),
            clean.impute_missing(h2, "hop2_abstract", "hop2_title", "hop2_year", mid),
            mid,
        )

    @landed
    def layers(self) -> DataFrame:
        """(paper_id, title, abstract, year, layer) of the cleaned, imputed layers."""
        return graph.assign_layers(*self._imputed())

    @landed
    def merged(self) -> DataFrame:
        return graph.merge_edges(self.clean1, self.clean2)

    @cached_property
    def citations(self) -> DataFrame:
        """Labelled citation rows: lines citing a seed."""
        return self._hop_rows.where(F.col("cited_type") == SEED_TYPE).select(
            F.col("context").alias("string"),
            "label",
            F.col("citing_id").alias("citingPaperId"),
            F.col("cited_id").alias("citedPaperId"),
            F.col("l_linestatus").alias("sectionName"),
            F.col("title").alias("citingPaperTitle"),
            "seq",
        )

    @cached_property
    def hop2_edges(self) -> DataFrame:
        """Second-layer rows with author ids as a JSON list, some of them broken."""
        ids = F.when(F.col("label") == "unknown", F.lit('["broken')).otherwise(
            F.to_json(F.array("brand", F.coalesce("title", F.lit("no title"))))
        )
        return self._hop_rows.where(F.col("cited_type") != SEED_TYPE).select(
            F.col("cited_id").alias("hop1_paper_id"),
            F.col("citing_id").alias("hop2_paper_id"),
            F.col("title").alias("hop2_title"),
            F.col("year").alias("hop2_year"),
            F.col("abstract").alias("hop2_abstract"),
            F.when(F.col("label").isNotNull(), ids).alias("hop2_author_ids"),
            F.col("context").alias("citation_context"),
            "seq",
        )

    @cached_property
    def training_log(self) -> DataFrame:
        """One epoch per event."""
        return self.events.select(
            F.col("event_id").alias("epoch"),
            F.col("value").alias("loss"),
            (F.get_json_object("props", "$.k").cast("double") / 100).alias("accuracy"),
            (F.col("value") / 1000).alias("lambda"),
        )

    @cached_property
    def _graph(self) -> tuple[DataFrame, DataFrame]:
        return graph.graph_tables(self.citations, self.hop2_edges)

    @landed
    def graph_nodes(self) -> DataFrame:
        return self._graph[0]

    @landed
    def graph_edges(self) -> DataFrame:
        return self._graph[1]

    @landed
    def labelled(self) -> DataFrame:
        """Edges with features, split, intent code and key flag, for the models."""
        coded = graph.encode_intent(features.edge_split(self.cites), "intent")
        return features.edge_features(coded, self.vectors)

    @property
    def taught(self) -> DataFrame:
        """Edges with their ends' vectors, split, intent code and key flag, for joint training; landed once a session."""
        key = (self.spark.sparkContext.applicationId, self.dir, self.files, "taught")
        if key not in _LANDED:
            edges = self.cites.select("citing_id", "cited_id", "intent", "is_key", "delta_t")
            coded = graph.encode_intent(features.edge_split(edges), "intent")
            coded = coded.withColumn("key_code", F.col("is_key").cast("int"))
            _LANDED[key] = (features.interactions(coded, self.vectors, multiplied=False),)
        return _LANDED[key][0]

    @cached_property
    def vectors(self) -> DataFrame:
        """A 64-d vector per part; the embeddings are dealt out in turn."""
        n = self.embeddings.agg(F.max("vec_id") + 1)
        keyed = self.part.select(
            F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("paper_id"),
            F.pmod(F.col("p_partkey"), n.scalar()).alias("vec_id"),
        )
        vec = self.embeddings.select("vec_id", F.col("embedding").alias("vector"))
        return spread_join(keyed, vec, "vec_id").select("paper_id", "vector")


# name: (views it rests on, SQL)
CTES: dict[str, tuple[str, str]] = {
    "raw_docs": (
        "",
        """
  SELECT d.doc_id, split_part(d.text, chr(10), 1) AS title,
         CASE WHEN coalesce(l.quality, 1) <> 0 THEN d.text END AS abstract,
         CASE WHEN coalesce(l.toxic, 0) = 1 THEN CAST([] AS VARCHAR[])
              ELSE ['A' || CAST(d.n_chars % 97 AS VARCHAR), 'A' || CAST(d.doc_id % 89 AS VARCHAR),
                    d.source || ' ' || d.lang] END AS authors,
         CAST(2000 + d.doc_id % 25 AS INTEGER) AS year,
         CASE WHEN d.lang = 'en' THEN 'arxiv' ELSE 's2orc' END AS source
  FROM documents d LEFT JOIN labels l USING (doc_id)""",
    ),
    "papers": (
        "raw_docs",
        """
  SELECT paper_id, title, abstract, authors, year, source FROM (
    SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS rn FROM (
      SELECT doc_id, lower(title) AS title, lower(abstract) AS abstract, authors, year, source,
             sha256(lower(title) || CAST(year AS VARCHAR)) AS paper_id
      FROM raw_docs WHERE abstract IS NOT NULL AND year IS NOT NULL AND len(authors) > 0))
  WHERE rn = 1""",
    ),
    "authorship": (
        "",
        """
  SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, s_name AS author,
         CAST(year(o_orderdate) AS INTEGER) AS year
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey""",
    ),
    "nodes": (
        "",
        """
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS paper_id,
         CASE WHEN p_size <> 21 THEN p_name END AS title,
         CASE WHEN p_size NOT IN (7, 21) THEN p_name || ' ' || p_type || ' ' || p_brand END AS abstract,
         CAST(CASE WHEN p_size <> 13 THEN 1974 + p_size END AS INTEGER) AS year,
         p_type, p_size, p_brand
  FROM part""",
    ),
    "cite_rows": (
        "",
        """
  SELECT 'P' || CAST(lead AS VARCHAR) AS citing_id, 'P' || CAST(l_partkey AS VARCHAR) AS cited_id,
         l_orderkey * 10 + l_linenumber AS seq,
         CASE WHEN l_quantity = 1 THEN NULL
              WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'method'
              WHEN l_returnflag = 'A' THEN 'Method' WHEN l_returnflag = 'R' THEN 'result'
              WHEN l_linestatus = 'O' THEN 'background' ELSE 'unknown' END AS label,
         CASE WHEN abs(l_discount) > 0
              THEN 'line ' || l_linestatus || ' of ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) END
           AS context,
         l_returnflag, l_linestatus, l_quantity, abs(l_discount) AS l_discount
  FROM lineitem
  JOIN (SELECT l_orderkey, max(l_partkey) AS lead FROM lineitem GROUP BY l_orderkey) USING (l_orderkey)
  WHERE l_partkey < lead""",
    ),
    "cites": (
        "cite_rows nodes",
        """
  SELECT citing_id, cited_id,
         CASE flag WHEN 'A' THEN 'Method' WHEN 'R' THEN 'Result' ELSE 'Background' END AS intent,
         discount * 10 AS importance, quantity > 25 AS is_key, context,
         s.year AS citing_year, t.year AS cited_year,
         greatest(1, coalesce(s.year - t.year, 1)) AS delta_t
  FROM (SELECT citing_id, cited_id, min(l_returnflag) AS flag, min(l_discount) AS discount,
               min(l_quantity) AS quantity, min(context) AS context
        FROM cite_rows GROUP BY ALL)
  JOIN nodes s ON s.paper_id = citing_id JOIN nodes t ON t.paper_id = cited_id""",
    ),
    "weighted": (
        "cites",
        f"""
  SELECT *, CASE intent WHEN 'Background' THEN 0.5 WHEN 'Method' THEN 1.5 WHEN 'Result' THEN 1.2 END
            AS intent_multiplier,
         exp(-{LAMBDA} * delta_t) AS decay_factor,
         CASE intent WHEN 'Background' THEN 0.5 WHEN 'Method' THEN 1.5 WHEN 'Result' THEN 1.2 END
            * exp(-{LAMBDA} * delta_t) AS semantic_weight
  FROM cites""",
    ),
    "predictions": ("cites", "SELECT *, importance AS semantic_weight FROM cites"),
    "writes": (
        "",
        """
  SELECT p_brand AS author_id, 'P' || CAST(p_partkey AS VARCHAR) AS paper_id FROM part
  UNION ALL SELECT p_type, 'P' || CAST(p_partkey AS VARCHAR) FROM part
  UNION ALL SELECT 'S' || CAST(l_suppkey AS VARCHAR), 'P' || CAST(l_partkey AS VARCHAR)
            FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) >= 2""",
    ),
    "cited_scores": (
        "weighted",
        """
  SELECT cited_id AS paper_id, sum(semantic_weight) AS s_c, count(*) AS raw
  FROM weighted GROUP BY cited_id""",
    ),
    "citing_values": (
        "cited_scores",
        """
  SELECT w.cited_id AS paper_id, coalesce(s.raw, 0) AS raw, round(coalesce(s.s_c, 0), 9) AS s_c
  FROM weighted w LEFT JOIN cited_scores s ON s.paper_id = w.citing_id""",
    ),
    "paper_h": (
        "citing_values",
        """
  SELECT paper_id, CAST(sum(CASE WHEN raw >= r1 THEN 1 ELSE 0 END) AS DOUBLE) AS h_p,
         CAST(sum(CASE WHEN s_c >= r2 THEN 1 ELSE 0 END) AS DOUBLE) AS sh_p
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY raw DESC) AS r1,
               row_number() OVER (PARTITION BY paper_id ORDER BY s_c DESC) AS r2
        FROM citing_values)
  GROUP BY paper_id""",
    ),
    "coauthors": ("writes", "SELECT paper_id, count(*) AS a_i FROM writes GROUP BY paper_id"),
    "seeds_meta": (
        "nodes",
        f"""
  SELECT chr(9) || paper_id || ' ' AS source_paper_id, title, abstract, year,
         p_brand || ' , ' || p_type AS authors
  FROM nodes WHERE p_type = '{SEED_TYPE}' AND p_size <> 50""",
    ),
    "hop_rows": (
        "cite_rows nodes",
        """
  SELECT r.citing_id, r.cited_id, r.seq, r.label, r.context, r.l_linestatus, t.p_type AS cited_type,
         s.title, s.abstract, s.year, s.p_brand AS brand
  FROM cite_rows r JOIN nodes t ON t.paper_id = r.cited_id JOIN nodes s ON s.paper_id = r.citing_id""",
    ),
    "hop1": (
        "hop_rows",
        f"""
  SELECT citing_id || CASE l_linestatus WHEN 'F' THEN ' ' || chr(10) ELSE '' END AS hop1_id,
         CASE l_linestatus WHEN 'F' THEN ' ' || chr(10) ELSE '' END || cited_id AS hop0_id,
         title AS hop1_title, abstract AS hop1_abstract, year AS hop1_year,
         label AS intent_label, context AS citation_text, seq
  FROM hop_rows WHERE cited_type = '{SEED_TYPE}'""",
    ),
    "hop2": (
        "hop_rows",
        f"""
  SELECT citing_id AS hop2_id, cited_id AS hop1_id, title AS hop2_title, abstract AS hop2_abstract,
         year AS hop2_year, context AS citation_text, seq
  FROM hop_rows WHERE cited_type <> '{SEED_TYPE}' OR l_linestatus = 'O'""",
    ),
    "clean0": (
        "seeds_meta",
        """
  SELECT trim(source_paper_id, ' ' || chr(9) || chr(10)) AS source_paper_id, title, abstract, year,
         authors
  FROM seeds_meta""",
    ),
    "clean1": (
        "hop1",
        """
  SELECT hop1_id, hop0_id, hop1_title, hop1_abstract, hop1_year, intent_label, citation_text, seq
  FROM (
    SELECT *, row_number() OVER (PARTITION BY hop1_id, hop0_id ORDER BY unknown, intent_label NULLS LAST,
              seq, hop1_title NULLS FIRST, hop1_abstract NULLS FIRST, hop1_year NULLS FIRST,
              citation_text NULLS FIRST) AS rn
    FROM (SELECT * REPLACE (trim(hop1_id, ' ' || chr(9) || chr(10)) AS hop1_id,
                            trim(hop0_id, ' ' || chr(9) || chr(10)) AS hop0_id),
                 intent_label IS NULL OR lower(intent_label) = 'unknown' AS unknown FROM hop1))
  WHERE rn = 1""",
    ),
    "clean2_all": (
        "hop2",
        """
  SELECT hop2_id, hop1_id, hop2_title, hop2_abstract, hop2_year, citation_text, seq FROM (
    SELECT *, row_number() OVER (PARTITION BY hop2_id, hop1_id ORDER BY seq, hop2_title NULLS FIRST,
              hop2_abstract NULLS FIRST, hop2_year NULLS FIRST, citation_text NULLS FIRST) AS rn
    FROM hop2)
  WHERE rn = 1""",
    ),
    "clean2": (
        "clean1 clean2_all",
        """
  SELECT * FROM clean2_all c WHERE NOT EXISTS (
    SELECT 1 FROM clean1 a WHERE a.hop1_id = c.hop2_id AND a.hop0_id = c.hop1_id)""",
    ),
    "citations": (
        "hop_rows",
        f"""
  SELECT context AS string, label, citing_id AS citing_paper, cited_id AS cited_paper,
         l_linestatus AS section, title AS citing_title, seq
  FROM hop_rows WHERE cited_type = '{SEED_TYPE}'""",
    ),
    "hop2_edges": (
        "hop_rows",
        f"""
  SELECT cited_id AS hop1_paper_id, citing_id AS hop2_paper_id, title AS hop2_title, year AS hop2_year,
         abstract AS hop2_abstract, context AS citation_context, seq,
         CASE WHEN label <> 'unknown' THEN [brand, coalesce(title, 'no title')] END AS author_ids
  FROM hop_rows WHERE cited_type <> '{SEED_TYPE}'""",
    ),
    "active": (
        "citations hop2_edges",
        """
  SELECT * FROM citations WHERE citing_paper IN (SELECT hop1_paper_id FROM hop2_edges)""",
    ),
    "median": (
        "clean0 clean2",
        """
  SELECT CAST(coalesce(trunc(median(year)), 2018) AS INTEGER) AS y
  FROM (SELECT year FROM clean0 UNION ALL SELECT hop1_year FROM clean1
        UNION ALL SELECT hop2_year FROM clean2)""",
    ),
    "layers": (
        "median",
        """
  SELECT paper_id, coalesce(title, 'Unknown Title') AS title,
         coalesce(abstract, title, 'No abstract available') AS abstract,
         coalesce(year, (SELECT y FROM median)) AS year, layer
  FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rank, ord) AS rn FROM (
    SELECT source_paper_id AS paper_id, title, abstract, year, 0 AS layer, 0 AS rank, 0 AS ord FROM clean0
    UNION ALL SELECT hop1_id, hop1_title, hop1_abstract, hop1_year, 1, 1, seq FROM clean1
    UNION ALL SELECT DISTINCT hop0_id, 'Unknown Title', 'No abstract available',
                     (SELECT y FROM median), 0, 2, 0 FROM clean1
    UNION ALL SELECT hop2_id, hop2_title, hop2_abstract, hop2_year, 2, 3, seq FROM clean2))
  WHERE rn = 1""",
    ),
    "merged": (
        "clean2",
        """
  SELECT src, dst, intent_label, coalesce(citation_text, 'Citation context missing.') AS citation_text
  FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY rank) AS rn FROM (
    SELECT hop1_id AS src, hop0_id AS dst, intent_label, citation_text, 0 AS rank FROM clean1
    UNION ALL SELECT hop2_id, hop1_id, '-1', citation_text, 1 FROM clean2))
  WHERE rn = 1""",
    ),
    "graph_nodes": (
        "active",
        """
  SELECT id, grp, title FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY rank, ord, grp NULLS FIRST,
                                 title NULLS FIRST) AS rn FROM (
      SELECT citing_paper AS id, 'hop1' AS grp, citing_title AS title, 0 AS rank, -seq AS ord FROM active
      UNION ALL SELECT cited_paper, 'seed', NULL, 1, 0 FROM active
      UNION ALL SELECT hop2_paper_id, 'hop2', hop2_title, 2, seq FROM hop2_edges
      UNION ALL SELECT 'author_' || unnest(author_ids), 'author', NULL, 3, 0 FROM hop2_edges
      UNION ALL SELECT hop1_paper_id, NULL, NULL, 4, 0 FROM hop2_edges)
    WHERE id IS NOT NULL)
  WHERE rn = 1""",
    ),
    "graph_edges": (
        "active",
        """
  SELECT citing_paper AS source, cited_paper AS target, 'cites' AS kind FROM active
  UNION SELECT hop2_paper_id, hop1_paper_id, 'cites' FROM hop2_edges
  UNION SELECT 'author_' || a, hop2_paper_id, 'writes'
        FROM (SELECT unnest(author_ids) AS a, hop2_paper_id FROM hop2_edges)""",
    ),
    "training_log": (
        "",
        """
  SELECT event_id AS epoch, value AS loss,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS accuracy,
         value / 1000 AS lam
  FROM events""",
    ),
    "vectors": (
        "",
        """
  SELECT 'P' || CAST(p_partkey AS VARCHAR) AS paper_id, CAST(embedding AS DOUBLE[]) AS vector
  FROM part JOIN embeddings ON vec_id = p_partkey % (SELECT max(vec_id) + 1 FROM embeddings)""",
    ),
}

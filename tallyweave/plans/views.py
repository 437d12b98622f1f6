"""Graph views over the driver's tables: what stands for documents, entities, mentions, references and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.session import sized

EPOCH = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


class Views:
    """DataFrames over one folder of tables, each built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        sized(spark, sf_dir)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def doc_nodes(self) -> DataFrame:
        """Documents as nodes: label, name, properties, embedding, content_hash."""
        d = self.table("documents")
        e = self.table("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
        p = F.to_json(F.struct(F.col("source").alias("title"), F.col("lang").alias("domain"), F.sha2("text", 256).alias("contentHash")))
        return d.select("doc_id", F.lit("Document").alias("label"), doc_path().alias("name"), p.alias("properties"), F.sha2("text", 256).alias("content_hash")).join(e, "doc_id", "left").drop("doc_id")

    def entity_nodes(self) -> DataFrame:
        """Parts, suppliers, customers, nations and regions: label, name, properties."""
        told = lambda c: F.to_json(F.struct(c.alias("description")))
        t = self.table
        rows = [
            t("part").select(F.lit("Technology").alias("label"), F.concat(F.lit("part-"), F.col("p_partkey")).alias("name"), told(F.concat_ws(" ", "p_name", "p_type")).alias("properties")),
            t("supplier").select(F.lit("Organization"), "s_name", told(F.concat(F.lit("nation "), F.col("s_nationkey")))),
            t("customer").select(F.lit("Person"), "c_name", told(F.col("c_mktsegment"))),
            t("nation").select(F.lit("Topic"), "n_name", F.lit('{"name":"x","description":""}')),
            t("region").select(F.lit("Topic"), "r_name", F.lit("{}")),
        ]
        out = rows[0]
        for r in rows[1:]:
            out = out.union(r)
        return out

    def order_nodes(self) -> DataFrame:
        return self.table("orders").select(F.lit("Document").alias("label"), order_path("o_orderkey").alias("name"), F.to_json(F.struct(F.col("o_orderpriority").alias("title"))).alias("properties"))

    def nodes(self) -> DataFrame:
        return self.doc_nodes().select("label", "name", "properties").union(self.entity_nodes())

    def lines(self) -> DataFrame:
        """Entities of orders: path, pos, type, name, description. Lines are numbered within an order."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
        return self.table("lineitem").select(order_path("l_orderkey").alias("path"), F.row_number().over(w).alias("pos"), F.when(F.col("l_returnflag") == "R", "Tool").otherwise("Technology").alias("type"), F.concat(F.lit("part-"), F.col("l_partkey")).alias("name"), F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string")).alias("description"))

    def mentions(self) -> DataFrame:
        """Edges from parts and suppliers to the orders that name them, with provenance."""
        li = self.table("lineitem")
        sup = self.table("supplier").select("s_suppkey", "s_name")
        # repeats go while rows are two columns; names, paths and JSON are made of what is left
        parts = li.select("l_partkey", "l_orderkey").distinct().select("l_orderkey", F.lit("Technology").alias("label"), F.concat(F.lit("part-"), F.col("l_partkey")).alias("name"))
        by = li.join(sup, li.l_suppkey == sup.s_suppkey).select("s_name", "l_orderkey").distinct().select("l_orderkey", F.lit("Organization").alias("label"), F.col("s_name").alias("name"))
        path = order_path("l_orderkey")
        return parts.union(by).select(F.col("label").alias("source_label"), F.col("name").alias("source_name"), F.lit("APPEARS_IN").alias("relation_type"), F.lit("Document").alias("target_label"), path.alias("target_name"), F.to_json(F.struct(path.alias("documentPath"))).alias("properties"))

    def references(self) -> DataFrame:
        """supplier and customer REFERENCES nation REFERENCES region."""
        n = self.table("nation")
        edge = lambda df, a, name, b, to: df.select(F.lit(a).alias("source_label"), F.col(name).alias("source_name"), F.lit("REFERENCES").alias("relation_type"), F.lit(b).alias("target_label"), F.col(to).alias("target_name"), F.lit("{}").alias("properties"))
        s = self.table("supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
        c = self.table("customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
        r = n.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return edge(s, "Organization", "s_name", "Topic", "n_name").union(edge(c, "Person", "c_name", "Topic", "n_name")).union(edge(r, "Topic", "n_name", "Topic", "r_name"))

    def questions(self) -> DataFrame:
        """User turns as Question nodes."""
        c = self.table("conversations").where("role = 'user'").dropDuplicates(["conv_id", "turn"])
        return c.select("conv_id", "turn", F.lit("Question").alias("label"), question_name().alias("name"), F.to_json(F.struct(F.col("conv_id").cast("string").alias("createdAt"))).alias("properties"), F.expr(EPOCH).alias("created_at"))

    def answers(self) -> DataFrame:
        """ANSWERED_BY edges where the conversation has a later assistant turn."""
        last = self.table("conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
        q = self.questions().join(last, "conv_id").where("turn < last")
        return q.select(F.lit("Question").alias("source_label"), F.col("name").alias("source_name"), F.lit("ANSWERED_BY").alias("relation_type"), F.lit("Document").alias("target_label"), F.concat(F.lit("conv-"), F.col("conv_id")).alias("target_name"), F.lit("{}").alias("properties"))

    def stored(self) -> DataFrame:
        """What an earlier sync would have stored: Spanish documents are unknown, German ones differ, French ones have no
        hash, and every source once had one more document."""
        d = self.table("documents")
        h = F.when(F.col("lang") == "de", F.sha2(F.concat("text", F.lit("?")), 256)).when(F.col("lang") != "fr", F.sha2("text", 256))
        had = d.where("lang != 'es' OR lang IS NULL").select(doc_path().alias("path"), h.alias("content_hash"))
        gone = d.select(F.concat(F.lit("/docs/"), "source", F.lit("/gone.md")).alias("path"), F.lit("0").alias("content_hash")).distinct()
        return had.union(gone)

    def current(self) -> DataFrame:
        return self.table("documents").select(doc_path().alias("path"), F.sha2("text", 256).alias("content_hash"))


def doc_path():
    return F.concat(F.lit("/docs/"), F.col("source"), F.lit("/"), F.col("doc_id"), F.lit(".md"))


def order_path(column: str):
    return F.concat(F.lit("orders/"), F.col(column), F.lit(".md"))


def question_name():
    return F.concat(F.lit("q-"), F.col("conv_id"), F.lit("-"), F.col("turn"))


#: The same views in DuckDB SQL, as common table expressions.
SQL = {
    "doc_nodes": "SELECT 'Document' AS label, '/docs/' || source || '/' || doc_id || '.md' AS name, json_object('title', source, 'domain', lang, 'contentHash', sha256(text))::VARCHAR AS properties, embedding, sha256(text) AS content_hash FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "entity_nodes": "SELECT 'Technology' AS label, 'part-' || p_partkey AS name, json_object('description', p_name || ' ' || p_type)::VARCHAR AS properties FROM part UNION ALL SELECT 'Organization', s_name, json_object('description', 'nation ' || s_nationkey)::VARCHAR FROM supplier UNION ALL SELECT 'Person', c_name, json_object('description', c_mktsegment)::VARCHAR FROM customer UNION ALL SELECT 'Topic', n_name, '{\"name\":\"x\",\"description\":\"\"}' FROM nation UNION ALL SELECT 'Topic', r_name, '{}' FROM region",
    "order_nodes": "SELECT 'Document' AS label, 'orders/' || o_orderkey || '.md' AS name, json_object('title', o_orderpriority)::VARCHAR AS properties FROM orders",
    "nodes": "SELECT label, name, properties FROM doc_nodes UNION ALL SELECT * FROM entity_nodes",
    "lines": "SELECT 'orders/' || l_orderkey || '.md' AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS pos, CASE WHEN l_returnflag = 'R' THEN 'Tool' ELSE 'Technology' END AS type, 'part-' || l_partkey AS name, l_returnflag || ' ' || l_linestatus || ' ' || l_quantity::INT AS description FROM lineitem",
    "mentions": "SELECT DISTINCT source_label, source_name, 'APPEARS_IN' AS relation_type, 'Document' AS target_label, p AS target_name, json_object('documentPath', p)::VARCHAR AS properties FROM (SELECT 'Technology' AS source_label, 'part-' || l_partkey AS source_name, 'orders/' || l_orderkey || '.md' AS p FROM lineitem UNION ALL SELECT 'Organization', s_name, 'orders/' || l_orderkey || '.md' FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
    "refs": "SELECT 'Organization' AS source_label, s_name AS source_name, 'REFERENCES' AS relation_type, 'Topic' AS target_label, n_name AS target_name, '{}' AS properties FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT 'Person', c_name, 'REFERENCES', 'Topic', n_name, '{}' FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'Topic', n_name, 'REFERENCES', 'Topic', r_name, '{}' FROM nation JOIN region ON n_regionkey = r_regionkey",
    "questions": "SELECT DISTINCT conv_id, turn, 'Question' AS label, 'q-' || conv_id || '-' || turn AS name, json_object('createdAt', conv_id::VARCHAR)::VARCHAR AS properties, TIMESTAMP '2024-01-01 00:00:00' AS created_at FROM conversations WHERE role = 'user'",
    "answers": "SELECT 'Question' AS source_label, name AS source_name, 'ANSWERED_BY' AS relation_type, 'Document' AS target_label, 'conv-' || conv_id AS target_name, '{}' AS properties FROM questions JOIN (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id) USING (conv_id) WHERE turn < last",
    "stored": "SELECT '/docs/' || source || '/' || doc_id || '.md' AS path, CASE WHEN lang = 'de' THEN sha256(text || '?') WHEN lang <> 'fr' THEN sha256(text) END AS content_hash FROM documents WHERE lang <> 'es' OR lang IS NULL UNION ALL SELECT DISTINCT '/docs/' || source || '/gone.md', '0' FROM documents",
    "current_docs": "SELECT '/docs/' || source || '/' || doc_id || '.md' AS path, sha256(text) AS content_hash FROM documents",
}
_NEEDS = {"nodes": ("doc_nodes", "entity_nodes"), "answers": ("questions",)}


def with_views(*names: str, body: str, recursive: bool = False) -> str:
    """body with the named views (and what they need) before it."""
    order: list[str] = []
    for n in names:
        order += [*_NEEDS.get(n, ()), n]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(f"{n} AS ({SQL[n]})" for n in dict.fromkeys(order)) + "\n" + body

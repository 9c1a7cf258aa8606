"""RDF/XML as a table of triples, and what is read from it: labels, hierarchies, taxonomies.

A graph is a set: triples are distinct, and `ord` is the place of the first occurrence in its file.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import iri

TRIPLES = "graph string, ord long, s string, p string, o string, o_kind string, lang string"
_R = "{%s}" % iri.RDF


def parse(text: str | bytes, graph: str) -> Iterator[tuple]:
    """Rows of TRIPLES of an RDF/XML document, in document order: nested and typed nodes, nodeID, parseType, containers' li, and xml:lang and xml:base."""
    root = ET.fromstring(text)
    count = {"bnode": 0, "ord": 0}
    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def blank() -> str:
        count["bnode"] += 1
        return f"{graph}#bnode_{count['bnode']}"

    def row(s: str, p: str, o: str, kind: str, lang: str | None = None) -> tuple:
        count["ord"] += 1
        return graph, count["ord"], s, p, o, kind, lang

    def resolve(ref: str, base: str) -> str:
        return base + ref if ref.startswith("#") else ref

    def subject(e: ET.Element, base: str) -> tuple[str, str]:
        if (v := e.get(_R + "about")) is not None:
            return resolve(v, base), "uri"
        if (v := e.get(_R + "ID")) is not None:
            return f"{base}#{v}", "uri"
        if (v := e.get(_R + "nodeID")) is not None:
            return f"{graph}#{v}", "bnode"
        return blank(), "bnode"

    def node(e: ET.Element, s: str, base: str, lang: str | None) -> Iterator[tuple]:
        lang = e.get(f"{{{iri.XML}}}lang", lang)
        if name(e.tag) != iri.RDF + "Description":
            yield row(s, iri.TYPE, name(e.tag), "uri")
        for k, v in e.attrib.items():
            if not k.startswith((_R, f"{{{iri.XML}}}")) and k[0] == "{":
                yield row(s, name(k), v, "literal", lang)
        items = 0
        for c in e:
            p = name(c.tag)
            if p == iri.RDF + "li":
                items += 1
                p = f"{iri.RDF}_{items}"
            own = c.get(f"{{{iri.XML}}}lang", lang)
            kind = c.get(_R + "parseType")
            if (ref := c.get(_R + "resource")) is not None:
                yield row(s, p, resolve(ref, base), "uri")
            elif (ref := c.get(_R + "nodeID")) is not None:
                yield row(s, p, f"{graph}#{ref}", "bnode")
            elif kind == "Resource":
                o = blank()
                yield row(s, p, o, "bnode")
                inner = ET.Element(f"{_R}Description")
                inner.extend(list(c))
                yield from node(inner, o, base, own)
            elif kind == "Collection":
                at, via = s, p
                for member in c:
                    cell = blank()
                    yield row(at, via, cell, "bnode")
                    o, ok = subject(member, base)
                    yield row(cell, iri.RDF + "first", o, ok)
                    yield from node(member, o, base, own)
                    at, via = cell, iri.RDF + "rest"
                yield row(at, via, iri.RDF + "nil", "uri")
            elif len(c):
                for member in c:
                    o, ok = subject(member, base)
                    yield row(s, p, o, ok)
                    yield from node(member, o, base, own)
            else:
                yield row(s, p, c.text or "", "literal", own)

    base = root.get(f"{{{iri.XML}}}base", "")
    tops = list(root) if name(root.tag) == iri.RDF + "RDF" else [root]
    for e in tops:
        s, _ = subject(e, base)
        yield from node(e, s, base, root.get(f"{{{iri.XML}}}lang"))


def triples_of(texts: DataFrame) -> DataFrame:
    """Triples of RDF/XML documents in texts(path, content); the graph is the path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in TRIPLES.split(", ")]
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows = list(parse(content if isinstance(content, str) else bytes(content), p))
                for k in range(0, len(rows), 50_000):
                    yield pd.DataFrame(rows[k : k + 50_000], columns=names)

    return as_set(texts.select("path", "content").mapInPandas(run, TRIPLES))


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """Triples of all RDF/XML files of a path, a file a task."""
    return triples_of(spark.read.format("binaryFile").load(path))


def read_owl_classes(spark: SparkSession, path: str) -> DataFrame:
    """S1 for large flat ontologies: owl:Class elements by Spark's splittable XML reader, with a fixed schema; labels, synonyms and subClassOf only."""
    item = "struct<_VALUE: string, `_xml:lang`: string>"
    schema = f"`_rdf:about` string, `rdfs:label` array<{item}>, `oboInOwl:hasExactSynonym` array<{item}>, `rdfs:subClassOf` array<struct<`_rdf:resource`: string>>"
    rows = spark.read.schema(schema).option("rowTag", "owl:Class").xml(path).withColumn("graph", F.input_file_name()).withColumn("ord", F.monotonically_increasing_id())
    parts = [(iri.LABEL, "rdfs:label"), (iri.SYNONYMS[1], "oboInOwl:hasExactSynonym")]
    out = rows.select("graph", "ord", F.col("`_rdf:about`").alias("s"), F.lit(iri.SUBCLASS).alias("p"), F.explode("`rdfs:subClassOf`").alias("x")).select("graph", "ord", "s", "p", F.col("x.`_rdf:resource`").alias("o"), F.lit("uri").alias("o_kind"), F.lit(None).cast("string").alias("lang")).filter("o IS NOT NULL")
    for p, c in parts:
        out = out.unionByName(rows.select("graph", "ord", F.col("`_rdf:about`").alias("s"), F.lit(p).alias("p"), F.explode(f"`{c}`").alias("x")).select("graph", "ord", "s", "p", F.col("x._VALUE").alias("o"), F.lit("literal").alias("o_kind"), F.col("x.`_xml:lang`").alias("lang")))
    return out


def as_set(triples: DataFrame) -> DataFrame:
    return triples.groupBy("graph", "s", "p", "o", "o_kind", "lang").agg(F.min("ord").alias("ord")).select("graph", "ord", "s", "p", "o", "o_kind", "lang")


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that fit the given terms."""
    for c, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            triples = triples.filter(F.col(c) == v)
    return triples


def value(triples: DataFrame, p: str) -> DataFrame:
    """S3: (s, o): one object of each subject, the least, so that it is always the same one."""
    return match(triples, p=p).groupBy("s").agg(F.min("o").alias("o"))


def _clean(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def labels(triples: DataFrame, synonyms: tuple[str, ...] = iri.SYNONYMS) -> DataFrame:
    """(concept, labels): the last rdfs:label first, then the synonyms in document order."""
    main = match(triples, p=iri.LABEL).groupBy("s").agg(F.max_by(_clean(F.col("o")), F.struct("ord", "o")).alias("label"))
    rest = triples.filter(F.col("p").isin(*synonyms)).groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", _clean(F.col("o")).alias("o")))), lambda x: x["o"]).alias("rest"))
    joined = main.join(rest, "s", "full")
    first = F.when(F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array("label"))
    return joined.select(F.col("s").alias("concept"), F.concat(first, F.coalesce("rest", F.array().cast("array<string>"))).alias("labels"))


def hierarchy(triples: DataFrame, blank_nodes: bool = True) -> DataFrame:
    """(child, predicate, parent) of every subClassOf; blank nodes count as parents unless left out."""
    rows = match(triples, p=iri.SUBCLASS)
    if not blank_nodes:
        rows = rows.filter("o_kind <> 'bnode'")
    return rows.select(F.col("s").alias("child"), F.lit("broader").alias("predicate"), F.col("o").alias("parent"))


def taxonomy_clones(concepts: DataFrame, alt_labels: DataFrame, links: DataFrame, relink_clones: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Every third concept becomes two, with '2' added to the URI of the second: (concepts, alt labels, links, exact matches).

    concepts(concept, label), alt_labels(concept, label), links(concept, relation, other). Clones keep the
    preferred label; alternative labels go to the first and the second in turn. Links whose ends are both not
    cloned stay; with relink_clones the others stay too, between the first clones.
    """
    numbered = _ordinals(concepts)
    third = F.col("ordinal") % 3 == 0
    made = numbered.select("concept", "label", third.alias("cloned"), F.explode(F.when(third, F.array(F.col("concept"), F.concat("concept", F.lit("2")))).otherwise(F.array("concept"))).alias("uri"))
    k = F.row_number().over(Window.partitionBy("concept").orderBy("label"))
    alts = alt_labels.withColumn("k", k).join(numbered.select("concept", third.alias("cloned")), "concept")
    alts = alts.select(F.when(F.col("cloned") & (F.col("k") % 2 == 0), F.concat("concept", F.lit("2"))).otherwise(F.col("concept")).alias("concept"), "label")
    plain = numbered.filter(~third).select("concept") if not relink_clones else numbered.select("concept")
    kept = links.join(plain, "concept", "left_semi").join(plain.withColumnRenamed("concept", "other"), "other", "left_semi").select("concept", "relation", "other")
    one = numbered.filter(third).select(F.col("concept").alias("a"), F.concat("concept", F.lit("2")).alias("b"))
    matches = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return made.select(F.col("uri").alias("concept"), "label"), alts, kept, matches


def _ordinals(concepts: DataFrame) -> DataFrame:
    """Concepts with their ordinal from 0, numbered by range partitions."""
    from ..operators.hierarchy import numbered_nodes

    idx = numbered_nodes(concepts.select(F.col("concept").alias("node")))
    return concepts.join(idx.select(F.col("node").alias("concept"), F.col("idx").alias("ordinal")), "concept")

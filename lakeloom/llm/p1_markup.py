"""Problem 1: markup residue.

Template deduction by equivalence classes. Each page (document) is split into wrapper tokens told apart by context
(``wrappers.py``). Tokens with the same occurrence vector over the pages of one host form a class; a class of
two tokens and more that stand in one order on every page is valid; tokens too rare on their host are grouped over all
hosts. Classes nest by the wrapper around them, and ``template_slots`` gives what remains between a template's tokens.

``markup_found`` takes a page's markup from its valid classes that aren't inside code: ``NAMES`` says of which language
the tokens of a class are. An exact check follows: a grammar for each language (``markup.py``) must accept the page. It
removes what wraps text but is no markup (brackets, quotes, bare code). ``clean_markup`` gives the text without its markup.

Defined cases: null, empty and blank texts give an empty clean text, no language and no tokens. A null host is a host
of its own. Equal rows stay separate rows in ``clean_markup`` and are one page elsewhere. Columns of any other name pass
through ``clean_markup``, whose own columns are ``clean_text`` and ``markup_languages`` (one of the input's with that name is replaced).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_rows, not_blank, table, written
from .markup import HTML_ELEMENTS, clean, languages
from .wrappers import page_slots, page_tokens, signs_of

LANGUAGES = ("html", "markdown", "wiki", "latex")
#: Characters without one of which a text can't have markup; tested in the JVM before any text goes to Python.
MARKUP_SIGN = r"[<>&#*_`\[\]|={}\\$'~-]"
#: The tokens by which a class is known to be of a language.
NAMES = {
    "html": rf"^<(?:{'|'.join(HTML_ELEMENTS)})$|^<!--|^<!|^&",
    "markdown": r"^#{1,6}\^$|^(?:\*\*?|__|`)‹$|^\[$|^\]\($|^(?:```|~~~)|^>\^$|^[-=|:]+=$|^\[‹$",
    "wiki": r"^={2,6}(?:\^|‹)$|^\[\[‹$|^'{2,5}‹$|^\{\{‹$|^\{\||^\|[-}]|^-=$|^<(?:ref|nowiki)$|^\[‹$|^_",
    "latex": r"^\\|^\$\$?‹$",
}


def clean_markup(df: DataFrame, text: str = "content") -> DataFrame:
    """``df`` with ``clean_text`` and ``markup_languages``, one pass without any shuffle."""
    kept = df.drop("clean_text", "markup_languages")
    schema = T.StructType([*kept.schema.fields, T.StructField("clean_text", T.StringType()), T.StructField("markup_languages", T.ArrayType(T.StringType()))])
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            new = [pa.array([clean(t) for t in texts], pa.string()), pa.array([sorted(languages(t)) for t in texts], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "clean_text", "markup_languages"])

    return kept.mapInArrow(run, schema)


PAGES = "host string, page string, grammar int, tokens array<struct<token:string,n:int,first:int,last:int,outer:string>>"


def pages(df: DataFrame, host: Column, key: str = "id", text: str = "content") -> DataFrame:
    """(host, page, grammar, tokens): each page's wrapper tokens, and the languages (as bits) that a grammar accepts it in."""
    item = pa.struct([("token", pa.string()), ("n", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("outer", pa.string())])
    schema = pa.schema([("host", pa.string()), ("page", pa.string()), ("grammar", pa.int32()), ("tokens", pa.list_(item))])

    def rows(hosts: list, keys: list, texts: list) -> Iterator[tuple]:
        for h, k, t in zip(hosts, keys, texts):
            if tokens := page_tokens(t):
                found = languages(t)
                yield h, k, sum(1 << i for i, x in enumerate(LANGUAGES) if x in found), [dict(zip(("token", "n", "first", "last", "outer"), x)) for x in tokens]

    some = df.where(F.col(text).rlike(MARKUP_SIGN) & not_blank(F.col(text))).select(F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.col(key).cast("string").alias("page"), F.col(text).alias("text"))
    return some.mapInArrow(arrow_rows(rows, ["host", "page", "text"], schema), PAGES)


def _occurrences(found: DataFrame) -> DataFrame:
    return found.select("host", "page", "grammar", F.explode("tokens").alias("t")).select("host", "page", "grammar", "t.*")


def token_classes(found: DataFrame, min_support: int = 2) -> DataFrame:
    """(host, token, class_id, rank, support, total, outer): the class of each token of a host that has one.

    The occurrence vector is a fingerprint of all (page, count) pairs, built by partial aggregation and never as a list of
    pages. Tokens of no class on their host are grouped over all hosts; such a class has host ``*`` in its number.
    """
    seen = _occurrences(found).groupBy("host", "token").agg(F.count("*").alias("support"), F.sum("n").alias("total"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.avg("first").alias("place"), F.mode("outer", True).alias("outer"))
    seen = written(seen)

    def classes(of: DataFrame, number: Column) -> DataFrame:
        w = Window.partitionBy(number, "support", "total", "vector")
        own = of.withColumn("class_id", F.xxhash64(number, "support", "total", "vector")).withColumn("n", F.count("*").over(w)).where((F.col("support") >= min_support) & (F.col("n") > 1))
        return own.withColumn("rank", F.row_number().over(w.orderBy("place", "token"))).drop("n", "vector", "place")

    own = classes(seen, F.col("host"))
    rest = seen.join(own.select("host", "token"), ["host", "token"], "left_anti")
    every = seen.groupBy("token").agg(F.sum("support").alias("support"), F.sum("total").alias("total"), F.bit_xor("vector").alias("vector"), F.avg("place").alias("place"), F.mode("outer", True).alias("outer"))
    shared = rest.select("host", "token").join(classes(every, F.lit("*")), "token")
    return own.unionByName(shared)


def template_members(found: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, page, grammar, class_id, ordered): the classes on each page, and whether their tokens stand in order there."""
    on_page = _occurrences(found).join(classes.select("host", "token", "class_id", "rank"), ["host", "token"])
    seen = on_page.groupBy("host", "page", "class_id").agg(F.max("grammar").alias("grammar"), F.array_sort(F.collect_list(F.struct("rank", "first"))).alias("at"))
    places = F.transform("at", lambda x: x["first"])
    return seen.select("host", "page", "grammar", "class_id", (places == F.array_sort(places)).alias("ordered"))


def split_classes(classes: DataFrame, broken: DataFrame) -> DataFrame:
    """Classes whose tokens stand in no one order, taken apart by wrapper: coincidences of rare tokens on the same pages."""
    stem = F.regexp_replace("token", r"[‹›^$=;?>]", "")
    apart = classes.join(broken, "class_id").withColumn("class_id", F.xxhash64("class_id", stem))
    w = Window.partitionBy("host", "class_id")
    return apart.withColumn("n", F.count("*").over(w)).where("n > 1").withColumn("rank", F.row_number().over(w.orderBy("rank"))).drop("n").select(*classes.columns)


def deduce(df: DataFrame, host: Column, key: str = "id", text: str = "content", min_support: int = 2) -> tuple[DataFrame, DataFrame]:
    """The tokens of valid classes (as ``token_classes``), and the pages that have them (host, page, grammar, class_id)."""
    found = written(pages(df, host, key, text))
    classes = written(token_classes(found, min_support))
    members = written(template_members(found, classes))
    order = written(members.groupBy("class_id").agg(F.min("ordered").alias("ordered")))
    apart = written(split_classes(classes, order.where("not ordered").select("class_id")))
    again = written(template_members(found, apart))
    order = order.unionByName(again.groupBy("class_id").agg(F.min("ordered").alias("ordered"))).where("ordered").select("class_id")
    return classes.unionByName(apart).join(order, "class_id"), members.unionByName(again).join(order, "class_id").drop("ordered")


def template_classes(df: DataFrame, host: Column | None = None, key: str = "id", text: str = "content", min_support: int = 2) -> DataFrame:
    """(host, class_id, tokens, n_tokens, support, per_page, inside): the valid classes of each host; ``inside`` is the class that encloses one."""
    return _with_nesting(deduce(df, F.col("source") if host is None else host, key, text, min_support)[0])


def _with_nesting(good: DataFrame) -> DataFrame:
    around = good.select("host", F.col("token").alias("outer"), F.col("class_id").alias("inside"))
    first = good.where("rank = 1").select("host", "class_id", "outer").join(around, ["host", "outer"], "left").select("host", "class_id", "inside")
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"])
    whole = good.groupBy("host", "class_id", "support").agg(tokens.alias("tokens"), F.count("*").alias("n_tokens"), (F.max("total") / F.max("support")).alias("per_page"))
    return whole.join(first, ["host", "class_id"], "left").select("host", "class_id", "tokens", "n_tokens", "support", "per_page", F.when(F.col("inside") != F.col("class_id"), F.col("inside")).alias("inside"))


def template_slots(df: DataFrame, classes: DataFrame, host: Column | None = None, key: str = "id", text: str = "content") -> DataFrame:
    """(host, page, slot, slot_text): the parts of each page between the tokens of its host's template, in order."""
    own = classes.select("host", F.explode("tokens").alias("token")).groupBy("host").agg(F.array_sort(F.collect_set("token")).alias("template"))
    schema = pa.schema([("host", pa.string()), ("page", pa.string()), ("slot", pa.int32()), ("slot_text", pa.string())])

    def rows(hosts: list, keys: list, texts: list, templates: list) -> Iterator[tuple]:
        known: dict[str, set] = {}
        for h, k, t, template in zip(hosts, keys, texts, templates):
            if h not in known:
                known[h] = signs_of(template or [])
            for n, part in enumerate(page_slots(t, known[h])):
                yield h, k, n, part

    some = df.where(not_blank(F.col(text))).select(F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit("")).alias("host"), F.col(key).cast("string").alias("page"), F.col(text).alias("text")).join(own, "host", "left")
    return some.mapInArrow(arrow_rows(rows, ["host", "page", "text", "template"], schema), "host string, page string, slot int, slot_text string")


def named(classes: DataFrame) -> DataFrame:
    """(class_id, language): the languages whose tokens a class has; classes inside code have none."""
    langs = F.filter(F.array(*(F.when(F.col("token").rlike(pattern), F.lit(name)) for name, pattern in NAMES.items())), lambda x: x.isNotNull())
    return classes.where(~F.col("token").startswith("code:")).select("class_id", F.explode(langs).alias("markup")).distinct()


def markup_found(df: DataFrame, host: Column | None = None, key: str = "id", text: str = "content", checked: bool = True, min_support: int = 2) -> DataFrame:
    """(key, markup): one row for each page and language of its valid classes; without ``checked`` as deduction alone has it."""
    classes, members = deduce(df, F.lit("") if host is None else host, key, text, min_support)
    rows = members.join(named(classes), "class_id")
    if checked:
        bit = F.element_at(F.create_map(*(x for i, n in enumerate(LANGUAGES) for x in (F.lit(n), F.lit(1 << i)))), F.col("markup"))
        rows = rows.where(F.col("grammar").bitwiseAND(bit) > 0)
    return rows.select(F.col("page").alias(key), "markup").distinct()


def page_host(source: str = "metadata.source") -> Column:
    """The site of a chunk: the first part of its source's path, and the kind of file."""
    return F.concat(F.coalesce(F.regexp_extract(source, r"^([^/]*)/", 1), F.lit("")), F.lit(" "), F.coalesce(F.regexp_extract(source, r"(\.[A-Za-z0-9]+)$", 1), F.lit("")))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "simulated_vector_db").select("id", "content", page_host().alias("host"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_found(chunks(spark, sf_dir), F.col("host"))


def p1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_markup(chunks(spark, sf_dir).select("id", "content")).select("id", "clean_text", F.array_join("markup_languages", ",").alias("markup_languages"))


def p1_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_classes(chunks(spark, sf_dir), F.col("host")).withColumn("tokens", F.array_join("tokens", " "))


def p1_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = chunks(spark, sf_dir)
    return template_slots(df, template_classes(df, F.col("host")), F.col("host"))


QUERIES = {"p1_found": p1_found, "p1_clean": p1_clean, "p1_templates": p1_templates, "p1_slots": p1_slots}
SQL: dict[str, str] = {}

"""License scan by diagonal voting, with built-in functions only.

All rolling K-word hashes of a text are joined with those of the templates. A hit votes for
its diagonal, the text position less the template position. Diagonals at most NEIGHBOUR
apart are merged into one span, which holds words that were put in or left out; a span that
has enough of the template's distinct places, and isn't much longer, gives the label, unless
a span of another template fits the same place better.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftmap.llm.tables import row_key

#: Phrases of the base rule and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Template words up to which their k-grams are sent to every task; more are joined by hash.
BROADCAST_WORDS = 50_000
K = 3
NEIGHBOUR = 5
MIN_SHARE = 0.5
MAX_STRETCH = 1.5
_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_templates() -> list[tuple[str, str]]:
    """label, text of the package's templates: whole licenses and their standard headers, and notices of one line."""
    out = []
    for f in sorted(resources.files("driftmap.llm").joinpath("licenses").iterdir(), key=lambda f: f.name):
        text = f.read_text(encoding="utf-8")
        if f.name == "notices.txt":
            out += [tuple(line.split(": ", 1)) for line in text.splitlines()]
        else:
            out.append((f.name.removesuffix(".txt").removesuffix(".header"), text))
    return out


def _split(text: str) -> list[str]:
    """license_words of a template, on the driver."""
    return [x for x in re.split(_BREAK, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if x]


def telling_words(templates: Sequence[tuple[str, str]]) -> list[str]:
    """Words of which a text that has MIN_SHARE of a template's k-grams must have one: the longest that together stand in more than the other share of them."""
    found = set()
    for words in (_split(t) for _, t in templates):
        n = max(1, len(words) - K + 1)
        places: dict[str, set[int]] = {}
        for i, x in enumerate(words):
            places.setdefault(x, set()).update(range(max(0, i - K + 1), min(n, i + 1)))
        covered: set[int] = set()
        for x in sorted(places, key=lambda x: (x not in found, -len(x), x)):
            if len(covered) > (1 - MIN_SHARE) * n:
                break
            found.add(x)
            covered |= places[x]
    return sorted(found)


def license_words(text: Column) -> Column:
    """A-Z lower-cased, then the words; null counts as empty."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, _BREAK), "")


def _phrase_places(words: Column, phrase: str) -> Column:
    """Starts of a phrase; only texts that hold it are gone through word by word."""
    parts = phrase.split()
    at = lambda i: F.forall(F.array(*(F.lit(j) for j in range(len(parts)))), lambda j: F.element_at(words, i + j + 1) == F.element_at(F.array(*map(F.lit, parts)), j + 1))
    holds = F.size(words) >= len(parts)
    for p in parts:
        holds &= F.array_contains(words, p)
    found = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), at)
    return F.when(holds, found).otherwise(F.array().cast("array<int>"))


def template_grams(spark: SparkSession, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """template, label, n, tpos, t0.. of all K-word runs of the templates (label, text)."""
    rows = [(i, label, text) for i, (label, text) in enumerate(templates)]
    words = spark.createDataFrame(rows, "template int, label string, text string").select("template", "label", license_words(F.col("text")).alias("words")).filter(F.size("words") >= K)
    place = F.explode(F.sequence(F.lit(1), F.size("words") - K + 1)).alias("p")
    grams = words.select("template", "label", "words", (F.size("words") - K + 1).alias("n"), place)
    return grams.select("template", "label", "n", (F.col("p") - 1).alias("tpos"), *(F.element_at("words", F.col("p") + j).alias(f"t{j}") for j in range(K)))


def votes(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """_key, template, label, n, diagonal, places, first, last: the votes of each diagonal. docs: _key, words.

    Texts without a telling word can't hold a template and are left out.
    """
    told = F.arrays_overlap("words", F.array(*map(F.lit, telling_words(templates))))
    rolled = [F.col("words"), *(F.slice("words", j + 1, F.greatest(F.size("words") - j, F.lit(0))) for j in range(1, K))]
    long = docs.filter((F.size("words") >= K) & told).select("_key", F.posexplode(F.arrays_zip(*(c.alias(f"w{j}") for j, c in enumerate(rolled)))).alias("pos", "g"))
    text = [F.col(f"g.w{j}") for j in range(K)]
    grams = template_grams(docs.sparkSession, templates).withColumn("h", F.xxhash64(*(f"t{j}" for j in range(K))))
    small = sum(len(_split(t)) for _, t in templates) <= BROADCAST_WORDS
    hits = long.withColumn("h", F.xxhash64(*text)).join(F.broadcast(grams) if small else grams, "h")
    for j in range(K):
        hits = hits.filter(text[j] == F.col(f"t{j}"))
    by = hits.groupBy("_key", "template", "label", "n", (F.col("pos") - F.col("tpos")).alias("diagonal"))
    return by.agg(F.collect_set("tpos").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def spans(voted: DataFrame) -> DataFrame:
    """_key, label, first, last, share: neighbouring diagonals merged, then verified; of spans that overlap, those of the largest share."""
    by = Window.partitionBy("_key", "template").orderBy("diagonal")
    new = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(by) > NEIGHBOUR).cast("int"), F.lit(1))
    marked = voted.withColumn("new", new).withColumn("island", F.sum("new").over(by))
    merged = marked.groupBy("_key", "template", "label", "n", "island").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.size("places") / F.col("n")
    fits = (share >= MIN_SHARE) & (F.col("last") - F.col("first") + 1 <= MAX_STRETCH * F.col("n"))
    found = merged.withColumn("share", share).filter(fits).select("_key", "label", "first", (F.col("last") + K - 1).alias("last"), "share")
    other = found.select(*(F.col(c).alias(f"o_{c}") for c in ("_key", "first", "last", "share")))
    better = (F.col("_key") == F.col("o__key")) & (F.col("o_first") <= F.col("last")) & (F.col("first") <= F.col("o_last")) & (F.col("o_share") > F.col("share"))
    return found.join(other, better, "left_anti")


def scan_licenses(docs: DataFrame, templates: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans.

    templates: label, text; by default license_templates(). One row for each input row. score is the largest share of a template that a span of the
    text holds, 1 with a base phrase and 0 without either. Null and empty texts have no
    words, empty labels and score 0. Other columns are ignored.
    """
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    keyed = docs.select(*cols).withColumn("_key", row_key("doc_id", "text")).select("doc_id", "_key", license_words(F.col("text")).alias("words"))
    places = [_phrase_places(F.col("words"), p) for p in PHRASES]
    base = keyed.select("doc_id", "_key", F.size("words").cast("long").alias("n_words"), *(p.alias(f"p{i}") for i, p in enumerate(places)))
    every = F.concat(*(F.col(f"p{i}") for i in range(len(PHRASES))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values()))))
    base = base.select("doc_id", "_key", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(base_labels).alias("_base"))
    found = spans(votes(keyed.select("_key", "words"), templates or license_templates())).groupBy("_key").agg(F.collect_set("label").alias("_own"), F.max("share").alias("_share"), F.count("*").alias("_spans"))
    out = base.join(found, "_key", "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("_own", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), F.coalesce("_spans", F.lit(0).cast("long")).alias("n_spans"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _template_values() -> str:
    return ", ".join(f"({i}, '{label}', string_split('{' '.join(_split(t))}', ' '))" for i, (label, t) in enumerate(license_templates()))


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) q),
bh AS (SELECT doc_id, pos, CASE WHEN a = 'cc' AND b = 'by' THEN 'cc-by' WHEN a = 'general' AND b = 'public' AND c = 'license' THEN 'gpl'
       WHEN a = 'all' AND b = 'rights' AND c = 'reserved' THEN 'reserved' END AS label FROM p),
bs AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list(DISTINCT label)) AS base FROM bh WHERE label IS NOT NULL GROUP BY doc_id),
t(template, label, w) AS (VALUES {_template_values()}),
tg AS (SELECT template, label, len(w) - 2 AS n, i - 1 AS tpos, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT template, label, w, unnest(range(1, len(w) - 1)) AS i FROM t) q),
h AS (SELECT p.doc_id, tg.template, tg.label, tg.n, p.pos, tg.tpos, p.pos - tg.tpos AS diagonal FROM p JOIN tg ON p.a = tg.a AND p.b = tg.b AND p.c = tg.c),
dg AS (SELECT DISTINCT doc_id, template, diagonal FROM h),
mk AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {NEIGHBOUR} THEN 0 ELSE 1 END AS new FROM dg),
il AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM mk),
sp AS (SELECT h.doc_id, h.label, h.n, h.template, island, count(DISTINCT tpos) / CAST(h.n AS DOUBLE) AS share, min(pos) AS first, max(pos) + 2 AS last, max(pos) - min(pos) + 1 AS stretch
       FROM h JOIN il ON h.doc_id = il.doc_id AND h.template = il.template AND h.diagonal = il.diagonal GROUP BY h.doc_id, h.label, h.n, h.template, island),
fi AS (SELECT * FROM sp WHERE share >= {MIN_SHARE} AND stretch <= {MAX_STRETCH} * n),
be AS (SELECT * FROM fi a WHERE NOT EXISTS (SELECT 1 FROM fi b WHERE a.doc_id = b.doc_id AND b.first <= a.last AND a.first <= b.last AND b.share > a.share)),
ok AS (SELECT doc_id, list(DISTINCT label) AS own, max(share) AS share, count(*) AS n_spans FROM be GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN CAST(1 AS DOUBLE) ELSE coalesce(share, CAST(0 AS DOUBLE)) END AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN bs ON d.doc_id = bs.doc_id LEFT JOIN ok ON d.doc_id = ok.doc_id
"""

"""A trigram index of names, for searches that would else read every name.

Each name, in lower case and padded at its end, is listed under every three characters it holds. A search
reads the lists of a few of its term's trigrams, the shortest ones, keeps the names that stand in all of
them, and verifies those. A term of one or two characters reads the lists of the trigrams that begin with
it; only a term without any literal character reads all names. Lists are a stored table in buckets of
trigrams, so a search opens the buckets of its trigrams and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.sources.keyed import KeyedTable

#: Ends names, so that each character begins a trigram; in no name.
_PAD = "\x00"
#: Lists that one search reads at most, if its term has three characters.
LISTS = 3


def _literal_parts(term: str, wildcards: bool) -> list[str]:
    """The runs of a lower-case term that a name holds as they are: between % and _, a \\ before one is literal."""
    if not wildcards:
        return [term] if term else []
    parts, at, now = [], 0, ""
    while at < len(term):
        if term[at] == "\\" and at + 1 < len(term):
            now, at = now + term[at + 1], at + 2
            continue
        if term[at] in "%_":
            parts.append(now)
            now = ""
        else:
            now += term[at]
        at += 1
    return [p for p in [*parts, now] if p]


class NameIndex:
    """Names and their trigrams, stored under ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.names = KeyedTable(spark, f"{path}/names", "name string", ["name"], buckets)
        self.lists = KeyedTable(spark, f"{path}/lists", "gram string, name string", ["gram"], buckets)
        self.sizes = KeyedTable(spark, f"{path}/sizes", "gram string, names long", ["gram"], buckets)
        self.spark = spark

    def add(self, names: DataFrame) -> None:
        """Lists the names (column ``name``) that aren't listed yet; null names are left out."""
        new = names.select("name").where("name is not null").distinct()
        new = new.join(self.names.read(new), "name", "left_anti")
        padded = F.concat(F.lower("name"), F.lit(_PAD * 2))
        at = F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1)))
        grams = new.select("name", F.explode(F.array_distinct(F.transform(at, lambda n: F.substr(padded, n, F.lit(3))))).alias("gram"))
        self.lists.append(grams)
        self.names.append(new)
        # sizes only choose among lists; they are made anew for the trigrams of the new names
        touched = grams.select("gram").distinct()
        counted = self.lists.read(touched).join(touched, "gram", "left_semi").groupBy("gram").agg(F.count_distinct("name").alias("names"))
        self.sizes.replace(touched, counted)

    def _keys(self, grams: list[str]) -> DataFrame:
        return self.spark.createDataFrame([(g,) for g in grams], "gram string")

    def candidates(self, term: str, wildcards: bool = True) -> DataFrame:
        """Names (some that don't match among them) in which the term can be found."""
        parts = _literal_parts(self._lower(term), wildcards)
        grams = sorted({p[n:n + 3] for p in parts for n in range(len(p) - 2)})
        if grams:
            keys = self._keys(grams)
            held = {r["gram"]: r["names"] for r in self.sizes.read(keys).join(keys, "gram", "left_semi").collect()}
            if len(held) < len(grams):
                return self.spark.createDataFrame([], "name string")
            few = sorted(grams, key=lambda g: (held[g], g))[:LISTS]
            found = self.lists.read(self._keys(few)).where(F.col("gram").isin(few))
            return found.groupBy("name").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(few)).select("name")
        if parts:
            start = max(parts, key=len)
            keys = self.sizes.read().where(F.startswith("gram", F.lit(start))).select("gram")
            return self.lists.read(keys).join(keys, "gram", "left_semi").select("name").distinct()
        return self.names.read().distinct()

    def _lower(self, term: str) -> str:
        """As Spark lowers names."""
        return self.spark.range(1).select(F.lower(F.lit(term))).first()[0] if not term.isascii() else term.lower()

    def find(self, term: str, wildcards: bool = True) -> DataFrame:
        """The names that hold the term whatever its case; with ``wildcards`` % and _ in it are those of LIKE."""
        names = self.candidates(term, wildcards)
        if wildcards:
            return names.where(F.col("name").ilike(f"%{term}%"))
        return names.where(F.contains(F.lower("name"), F.lower(F.lit(term))))

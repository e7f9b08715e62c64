"""TF-IDF search from stored counts.

What is stored of a unit are its raw counts, one row per unit, terms as hashes of 64 bits; they never change. Document frequencies are kept apart as increments, one
folder per addition, and the lengths of the vectors, which follow the frequencies, as one small row per unit that is
computed anew. So adding units writes their counts, and reads but does not rewrite those of the others. Everything an
addition wrote counts from the commit of its manifest on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from answerloom.functions.ranking import round6
from answerloom.functions.skew import fits_broadcast, salted_join
from answerloom.operators.sparse import (
    counted_frequency,
    counted_topk,
    postings_of,
    query_terms,
    tfidf_query_weights,
    unit_counts,
    vector_lengths,
)
from answerloom.sources.manifest import Versioned


class TfidfStore(Versioned):
    @classmethod
    def create(cls, units: DataFrame, path: str) -> TfidfStore:
        self = cls(units.sparkSession, path)
        self._grow({"n": 0, "counts": [], "frequencies": []}, (self.versions() or [-1])[-1], units)
        return self

    def add(self, units: DataFrame) -> None:
        """Add units (uid, content) whose uid is new."""
        version, manifest = self._latest()
        self._grow(manifest, version, units)

    def _grow(self, manifest: dict, version: int, units: DataFrame) -> None:
        folder = self._write(unit_counts(units))
        written = self.spark.read.parquet(f"{self.path}/{folder}")
        increments = self._write(counted_frequency(written))
        manifest = {
            "n": manifest["n"] + units.count(),
            "counts": [*manifest["counts"], folder],
            "frequencies": [*manifest["frequencies"], increments],
        }
        norms = vector_lengths(self._read(manifest, "counts"), self._frequencies(manifest), manifest["n"])
        self._commit(manifest | {"norms": self._write(norms)}, version)

    def _read(self, manifest: dict, name: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in manifest[name]])

    def _frequencies(self, manifest: dict) -> DataFrame:
        return self._read(manifest, "frequencies").groupBy("t").agg(F.sum("df").alias("df"))

    def scores(self, queries: DataFrame, version: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
        """(q, uid, score): cosines of units with a common term, of ``pairs`` (q, uid) only if given; only counts of terms that are
        asked for are joined."""
        manifest = self.manifest(version)
        n, frequencies = manifest["n"], self._frequencies(manifest)
        fits = fits_broadcast(query_terms(queries))
        weighted = tfidf_query_weights(queries, n, frequencies, fits)
        counts = self._read(manifest, "counts")
        if pairs is None:
            met = salted_join(postings_of(counts), weighted, ["t"], ["uid"], fits=fits)
        else:
            wanted = pairs.select("uid").distinct()
            held = postings_of(counts.join(F.broadcast(wanted) if fits_broadcast(wanted) else wanted, "uid", "left_semi"))
            met = salted_join(held, pairs.select("q", "uid").distinct(), ["uid"], ["t"]).join(weighted, ["q", "t"])
        dots = met.groupBy("q", "uid").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
        norms = self.spark.read.parquet(f"{self.path}/{manifest['norms']}")
        return dots.join(norms, "uid").select("q", "uid", round6(F.col("dot") / F.col("norm")).alias("score"))

    def topk(self, queries: DataFrame, k: int = 5, version: int | None = None) -> DataFrame:
        manifest = self.manifest(version)
        counts = self._read(manifest, "counts").where(F.col("uid").isNotNull())
        norms = self.spark.read.parquet(f"{self.path}/{manifest['norms']}")
        return counted_topk(queries, counts, norms, self._frequencies(manifest), manifest["n"], k)

"""A-17 name search in set form: many search terms against all patients.

A substring match is a theta join, which Spark would plan as a nested loop. Here it is an
equi-join on a short gram that any name containing the term must contain: the rarest of the
term's three-letter grams, or the term itself where it is shorter. Patients are first
collapsed to their distinct full names (with count and smallest id), the joined pairs are
verified with ``contains``, and every term is aggregated map-side, so a frequent name costs
one row and nothing is gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelake.functions.expr import search_text
from carelake.operators.patients import name_match_candidates, resolve_search

GRAM = 3


def normalized_terms(terms: DataFrame, col: str = "term") -> DataFrame:
    return terms.select(search_text(col).alias("term")).where(F.col("term") != "").distinct()


def _grams(text, size):
    """Distinct substrings of ``size`` letters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, size)))


def search_matches(terms: DataFrame, patients: DataFrame) -> DataFrame:
    """(term, n, any_id, exact_id): per term with a match, the number of patients whose
    normalised full name contains it, the smallest id, and the smallest of exact matches."""
    names = (name_match_candidates(patients).where(F.col("n_full") != "").groupBy("n_full")
             .agg(F.count(F.lit(1)).alias("n"), F.min("patient_id").alias("id")))
    sizes = [F.lit(k) for k in range(1, GRAM + 1)]
    grams = names.select("*", F.explode(F.array_distinct(F.flatten(F.array(*[_grams(F.col("n_full"), k) for k in sizes])))).alias("gram"))
    wanted = terms.select("term", F.explode(_grams(F.col("term"), F.least(F.length("term"), F.lit(GRAM)))).alias("gram"))
    known = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("names"))
    rarest = (wanted.join(known, "gram", "left").groupBy("term")
              .agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("best"))
              .select("term", F.col("best.gram").alias("gram")))
    return (rarest.join(grams, "gram").where(F.contains("n_full", "term"))
            .groupBy("term").agg(F.sum("n").alias("n"), F.min("id").alias("any_id"),
                                 F.min(F.when(F.col("n_full") == F.col("term"), F.col("id"))).alias("exact_id")))


def patient_search(terms: DataFrame, patients: DataFrame, col: str = "term") -> DataFrame:
    t = normalized_terms(terms, col)
    return resolve_search(t, search_matches(t, patients))

"""Mixing to target weights by soft domain membership, in DataFrame operations only.

A labelled table (doc_id, domain) trains a naive Bayes classifier over binned rates of short strings
in the text; its table of log-probabilities gives every document posteriors over the domains.
Rates are then fitted by distributed projected gradient: with n tokens and posteriors p of each
document, w >= ``least_rate`` minimises

    1/2 r' B r + ridge/2 * sum n/N (w - 1)^2,   r = (sum w n p - targets) / N,

where B is the inverse of sum n/N p p' (plus ridge), which makes the steps well conditioned.  A step
needs one aggregate of as many sums as there are domains; the rates themselves stay an expression of
the posteriors and the past steps' coefficients, so no state is written between steps.

Edge cases: a null or empty text has no tokens and no string found in it; a null or repeated label
counts for no or several training rows; domains without a target are not trained on; without any
labelled row posteriors are even; rows with a null id are rated too; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import materialize

# Strings whose rates tell languages, running prose and junk apart.
STRINGS = (" the ", " of ", " and ", " der ", " die ", " und ", " que ", " la ", " le ", " les ", " los ", " el ",
           "ß", "ü", "ç", "è", "ñ", "ó", "%%%", "###", "!!", "|", "\n", ",", ".")
BINS = 8


def with_features(docs: DataFrame) -> DataFrame:
    """``docs`` with __tokens (words: blanks and line ends plus one, none in an empty text) and
    __bins (per string, 0 if absent, else 1 .. BINS - 1 by its rate per 1000 bytes)."""
    text = docs.withColumn("__text", F.coalesce(F.col("text").cast("string"), F.lit("")))

    def bytes_of(s: str) -> Column:
        left = F.octet_length(F.replace(F.col("__text"), F.lit(s), F.lit("")))
        return ((F.octet_length("__text") - left) / F.lit(len(s.encode()))).cast("int")

    hits = text.withColumns({"__size": F.octet_length("__text"), "__blanks": bytes_of(" ")}
                            | {f"__h{i}": bytes_of(s) for i, s in enumerate(STRINGS)}).drop("__text")
    step = "floor(log2(1.0D + 1000.0D * __h{0} / __size))"
    bins = [F.expr(f"if(__h{i} > 0, least({BINS - 1}, cast({step.format(i)} as int) + 1), 0)")
            for i in range(len(STRINGS))]
    lines = F.col(f"__h{STRINGS.index(chr(10))}")
    tokens = F.when(F.col("__size") > 0, F.col("__blanks") + lines + 1).otherwise(0).cast("long")
    return hits.withColumns({"__tokens": tokens, "__bins": F.array(*bins)}) \
        .drop("__size", "__blanks", *[f"__h{i}" for i in range(len(STRINGS))])


def fit_classifier(table: DataFrame, labelled: DataFrame, domains: list[str], softness: float) -> list[list[float]]:
    """Per domain: its log prior, then the log-probability of each bin of each string.  The counts
    are domains x strings x bins numbers, whatever the size of the input."""
    known = labelled.filter(F.col("domain").isin(domains)).select(F.col("doc_id").alias("__id"), "domain")
    rows = table.join(known, table["doc_id"] == known["__id"]) \
        .select("domain", F.posexplode("__bins").alias("f", "bin")).groupBy("domain", "f", "bin").count().collect()
    seen = {(r["domain"], r["f"], r["bin"]): r["count"] for r in rows}
    size = {d: sum(n for (x, f, _), n in seen.items() if x == d and f == 0) for d in domains}
    total, out = sum(size.values()), []
    for d in domains:
        line = [math.log((size[d] + 1) / (total + len(domains)))]
        for f in range(len(STRINGS)):
            line += [math.log((seen.get((d, f, b), 0) + 1) / (size[d] + BINS)) / softness for b in range(BINS)]
        out.append(line)
    return out


def with_posteriors(df: DataFrame, model: list[list[float]]) -> DataFrame:
    """``df`` with the posteriors __p0, __p1, ..., which add up to 1."""
    k = len(model)
    tables = df.withColumns({f"__t{i}": F.lit(line[1:]) for i, line in enumerate(model)})
    terms = [" + ".join(f"element_at(__t{i}, __bins[{f}] + {f * BINS + 1})" for f in range(len(STRINGS)))
             for i in range(k)]
    logs = tables.withColumns({f"__l{i}": F.expr(f"{model[i][0]!r}D + {terms[i]}") for i in range(k)})
    top = F.greatest(*[F.col(f"__l{i}") for i in range(k)]) if k > 1 else F.col("__l0")
    shifted = logs.withColumn("__top", top).withColumns({f"__e{i}": F.exp(F.col(f"__l{i}") - F.col("__top"))
                                                         for i in range(k)})
    total = reduce(lambda a, b: a + b, [F.col(f"__e{i}") for i in range(k)])
    normed = shifted.withColumn("__whole", total).withColumns({f"__p{i}": F.col(f"__e{i}") / F.col("__whole")
                                                             for i in range(k)})
    return normed.drop("__top", "__whole", *[f"__{x}{i}" for x in "tle" for i in range(k)])


def rate(steps: list[list[float]], k: int, ridge: float, least: float) -> Column:
    """The rates after ``steps``, as one expression over the posteriors."""
    eta = 1.0 / (1.0 + ridge)
    w = f"{max(1.0, least)!r}D"
    for c in steps:
        pull = " + ".join(f"__p{i} * ({eta * c[i]!r}D)" for i in range(k))
        w = f"greatest({least!r}D, {w} * {1.0 - eta * ridge!r}D + {eta * ridge!r}D - ({pull}))"
    return F.expr(w)


def _inverse(m: list[list[float]]) -> list[list[float]]:
    import numpy as np
    return np.linalg.inv(np.array(m)).tolist()


def fit_rates(table: DataFrame, shares: list[float], total: float | None, ridge: float, least: float,
              most_steps: int = 24, tolerance: float = 1e-5) -> list[list[float]]:
    """Coefficients of the steps.  ``total`` None: the least for which no domain must shrink."""
    k = len(shares)
    tokens = F.col("__tokens").cast("double")
    sums = [F.sum(tokens * F.col(f"__p{i}")) for i in range(k)]
    products = [F.sum(tokens * F.col(f"__p{i}") * F.col(f"__p{j}")) for i in range(k) for j in range(k)]
    first = table.agg(F.sum(tokens), *sums, *products).first()
    n = first[0] or 0.0
    if n <= 0:
        return []
    here = [float(x) for x in first[1:k + 1]]
    whole = max((h / s for h, s in zip(here, shares) if s > 0), default=n) if total is None else total
    goal = [whole * s for s in shares]
    b = _inverse([[first[1 + k + i * k + j] / n + (ridge if i == j else 0.0) for j in range(k)] for i in range(k)])
    steps: list[list[float]] = []
    if least > 1.0:
        here = [h * least for h in here]
    before = None
    for _ in range(most_steps):
        r = [(h - g) / n for h, g in zip(here, goal)]
        steps.append([sum(b[i][j] * r[j] for j in range(k)) for i in range(k)])
        w = rate(steps, k, ridge, least)
        got = table.withColumn("__w", w).agg(*[F.sum(tokens * F.col("__w") * F.col(f"__p{i}")) for i in range(k)]).first()
        here = [float(x) for x in got]
        if before is not None and max(abs(x - y) for x, y in zip(here, before)) <= tolerance * n:
            break
        before = here
    return steps


def copies(rate_col: Column, id_col: Column) -> Column:
    """Whole copies with the rate as their mean: a hash of the id decides on the last one."""
    even = F.pmod(F.xxhash64(id_col, F.lit(29)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate_col + even).cast("int")


def row_key() -> dict[str, Column]:
    """Hashes that name a row by its id and text, nulls included."""
    return {"__row": F.xxhash64("doc_id", "text"), "__sum": F.crc32(F.coalesce(F.col("text"), F.lit("")))}


@dataclass
class Mixture:
    """A fitted classifier and the steps of the fitted rates."""

    domains: list[str]
    model: list[list[float]]
    steps: list[list[float]]
    ridge: float
    least: float


def fit(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], total: float | None = -1.0,
        least_rate: float = 0.0, ridge: float = 0.01, softness: float = 4.0) -> tuple[Mixture, DataFrame]:
    """The mixture, and the table (doc_id, row key, __tokens, __bins, posteriors) that it was fitted on.

    ``targets``: each domain's share of all tokens (scaled to 1).  ``total``: tokens aimed at; -1 for
    as many as there are, None for the least for which no domain must shrink.  ``softness`` divides
    the classifier's evidence, since its strings are not independent.
    """
    domains = sorted(targets)
    scale = sum(targets.values())
    shares = [targets[d] / scale for d in domains]
    rows = with_features(docs.select("doc_id", "text")).withColumns(row_key())
    table = materialize(rows.select("doc_id", "__row", "__sum", "__tokens", "__bins"), "bins")
    model = fit_classifier(table, labelled, domains, softness)
    scored = materialize(with_posteriors(table, model), "posteriors")
    if total == -1.0:
        total = float(scored.agg(F.sum("__tokens")).first()[0] or 0)
    steps = fit_rates(scored, shares, total, ridge, least_rate)
    return Mixture(domains, model, steps, ridge, least_rate), scored


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **how) -> DataFrame:
    """Rows (doc_id, n_tokens, domain, posterior, rate, copies) for every document."""
    m, scored = fit(docs, labelled, targets, **how)
    k = len(m.domains)
    p = F.array(*[F.col(f"__p{i}") for i in range(k)])
    rated = scored.withColumn("__rate", rate(m.steps, k, m.ridge, m.least)).withColumn("posterior", p)
    names = F.array(*[F.lit(d) for d in m.domains])
    best = F.element_at(names, F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return rated.select("doc_id", F.col("__tokens").alias("n_tokens"), best.alias("domain"), "posterior",
                        F.col("__rate").alias("rate"), copies(F.col("__rate"), F.col("doc_id")).alias("copies"))


def remix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], **how) -> DataFrame:
    """``docs`` with each row as many times as its rate says; all columns as they are.

    Only rows with other than one copy are looked up, by hashes of the id and the text.
    """
    m, scored = fit(docs, labelled, targets, **how)
    rates = rate(m.steps, len(m.domains), m.ridge, m.least)
    counted = scored.withColumn("__copies", copies(rates, F.col("doc_id"))).select("__row", "__sum", "__copies")
    other = materialize(counted.filter("__copies != 1").distinct(), "copies")
    rows = docs.withColumns(row_key()).join(other, ["__row", "__sum"], "left") \
        .withColumn("__copies", F.coalesce("__copies", F.lit(1))).filter("__copies > 0")
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(docs.columns)


def quality_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled table (doc_id, domain): the language and the labelled quality of documents."""
    known = labels.filter(F.col("quality").isNotNull()).select(F.col("doc_id"), "quality")
    return docs.filter(F.col("lang").isNotNull()).select("doc_id", "lang").join(known, "doc_id") \
        .select("doc_id", F.concat_ws("/", "lang", F.when(F.col("quality") == 1, "good").otherwise("poor")).alias("domain"))


#: Shares of all tokens for the query and the pipeline: a parameter, not a property of the data.
TARGETS = {"en/good": 0.50, "de/good": 0.14, "fr/good": 0.14, "es/good": 0.10,
           "en/poor": 0.07, "de/poor": 0.02, "fr/poor": 0.02, "es/poor": 0.01}

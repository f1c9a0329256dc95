"""Next-token distributions as array columns: one row holds a logit vector, so that nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with the value computed once: what stands inside a lambda is computed again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repetition_penalty(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of ids that were generated already: divided by the penalty if not negative, else multiplied."""
    if penalty <= 0:
        raise ValueError("penalty must be positive")
    if penalty == 1:
        return logits
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i.cast("int")), F.when(x < 0, x * penalty).otherwise(x / penalty)).otherwise(x))


def temperature(logits: Column, t: float) -> Column:
    if t <= 0:
        raise ValueError("use greedy() for a temperature of zero")
    return F.transform(logits, lambda x: x / F.lit(t))


def greedy(logits: Column) -> Column:
    """The id of the largest logit; of equal ones the lowest."""
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def top_k(logits: Column, k: int) -> Column:
    """Logits below the k-th largest become null; ties with it stay. 0 keeps all."""
    if k <= 0:
        return logits
    kth = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return let(kth, lambda m: F.transform(logits, lambda x: F.when(x >= m, x)))


def softmax(logits: Column) -> Column:
    """Probabilities; null logits get none (null)."""
    shifted = let(F.array_max(logits), lambda m: F.transform(logits, lambda x: F.exp(x - m)))
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return let(shifted, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def top_p(logits: Column, p: float) -> Column:
    """Logits whose more likely tokens already hold more than p become null; the first always stays. 1 keeps all."""
    if p >= 1:
        return logits

    def ranked(probs):
        return F.array_sort(F.filter(F.transform(probs, lambda q, i: F.struct((-q).alias("m"), i.cast("int").alias("id"))), lambda s: s["m"].isNotNull()))

    def last_kept(order):
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(-2.0).alias("m"), F.lit(-1).alias("id"))
        step = lambda a, s: F.when(a["sum"] > p, a).otherwise(F.struct((a["sum"] - s["m"]).alias("sum"), s["m"].alias("m"), s["id"].alias("id")))
        return F.aggregate(order, start, step)

    def cut(l, probs):
        # kept is what ranks no later than the last one that is
        kept = lambda q, i, k: (-q < k["m"]) | ((-q == k["m"]) & (i.cast("int") <= k["id"]))
        return let(last_kept(ranked(probs)), lambda k: F.transform(probs, lambda q, i: F.when(kept(q, i, k), F.get(l, i))))

    return let(logits, lambda l: let(softmax(l), lambda probs: cut(l, probs)))


def draw(logits: Column, uniform: Column) -> Column:
    """The id at which the cumulative probability, in the order of ids, first exceeds a number from 0 to 1."""
    probs = softmax(logits)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(-1).alias("id"), F.lit(-1).alias("i"), F.lit(-1).alias("last"))

    def step(a, q):
        total = a["sum"] + F.coalesce(q, F.lit(0.0))
        i = a["i"] + 1
        return F.struct(total.alias("sum"), F.when((a["id"] < 0) & (total > uniform), i).otherwise(a["id"]).alias("id"), i.alias("i"), F.when(q.isNotNull(), i).otherwise(a["last"]).alias("last"))

    return F.aggregate(probs, start, step, lambda a: F.when(a["id"] >= 0, a["id"]).otherwise(a["last"]))


def distinct_ids(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def output_ids(ids: Column, n_prompt: Column, stops: list[int], full: bool = False, keep_stop: bool = False) -> Column:
    """What is shown of generated ids: without the prompt unless full, and without a stop id at the end unless kept."""
    out = ids if full else F.slice(ids, n_prompt + 1, F.greatest(F.size(ids) - n_prompt, F.lit(0)))
    if keep_stop or not stops:
        return out
    ends = (F.size(out) > 0) & F.array_contains(F.array(*map(F.lit, stops)), F.element_at(out, -1))
    return F.when(F.size(out) == 0, out).when(ends, F.slice(out, 1, F.size(out) - 1)).otherwise(out)


def without(ids: Column, specials: list[int]) -> Column:
    """Ids that are not special."""
    return F.filter(ids, lambda x: ~x.isin(specials)) if specials else ids


def exploded_top_k(rows: DataFrame, k: int, row: str = "vec_id", logits: str = "embedding") -> DataFrame:
    """(row, id, logit) of the survivors of top_k."""
    return rows.select(row, F.posexplode(top_k(F.transform(logits, lambda x: x.cast("double")), k)).alias("id", "logit")).where("logit is not null")

"""Score post-processing on ``ARRAY`` columns of logits, all as built-in array functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    An expression written inside an array function's lambda is computed once per element; a
    lambda variable is not.
    """
    return F.transform(F.array(value), body)[0]


def doubles(logits: Column) -> Column:
    return logits.cast("array<double>")


def softcap(logits: Column, cap: float = 15.0) -> Column:
    return F.transform(doubles(logits), lambda x: cap * F.tanh(x / cap))


def log_sum_exp(wide: Column) -> Column:
    return let(
        F.array_max(wide),
        lambda top: F.log(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))) + top,
    )


def token_nll(logits: Column, target: Column) -> Column:
    """Negative log-likelihood in nats of a 0-based target; NULL outside the vocabulary."""
    inside = (target >= 0) & (target < F.size(logits))
    nats = let(doubles(logits), lambda wide: log_sum_exp(wide) - F.get(wide, target))
    return F.when(inside, nats)


def top_k_mask(logits: Column, k: int) -> Column:
    """-inf for everything below the k-th largest value; ties with it all stay."""

    def mask(wide: Column) -> Column:
        kth = F.element_at(F.sort_array(wide, asc=False), F.least(F.lit(k), F.size(wide)))
        return let(kth, lambda t: F.transform(wide, lambda x: F.when(x < t, F.lit(NEG_INF)).otherwise(x)))

    return let(doubles(logits), mask)


def tempered(logits: Column, temperature: float) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive; use greedy() for 0")
    return F.transform(doubles(logits), lambda x: x / temperature)


def softmax(logits: Column) -> Column:
    def normalise(wide: Column) -> Column:
        return let(log_sum_exp(wide), lambda norm: F.transform(wide, lambda x: F.exp(x - norm)))

    return let(doubles(logits), normalise)


def greedy(logits: Column) -> Column:
    """0-based index of the first maximum."""
    return let(logits, lambda l: F.array_position(l, F.array_max(l)) - 1).cast("int")


def uniform(row_id: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from the first 52 bits of md5(``row_id:seed``)."""
    digits = F.substring(F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / F.lit(float(1 << 52))


def sample(logits: Column, row_id: Column, temperature: float, seed: int, k: int | None = None) -> Column:
    """A token drawn by softmax(logits / temperature); greedy at temperature 0.

    The cumulative probabilities are cut at one uniform number per row, hashed from the row and the
    seed: the draw depends on the data alone, not on partitioning or retries.
    """
    kept = doubles(logits) if k is None else top_k_mask(logits, k)
    if temperature <= 0:
        return greedy(kept)

    def below(scores: Column, drawn: Column) -> Column:
        """How many tokens end at or below the drawn number."""

        def step(acc: Column, x: Column) -> Column:
            total = acc["total"] + x
            return F.struct(total.alias("total"), (acc["n"] + (total <= drawn).cast("int")).alias("n"))

        return F.aggregate(scores, F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")), step, lambda acc: acc["n"])

    def choose(scores: Column) -> Column:
        # Rounding may leave the last sum below the drawn number: then the last possible token.
        last = F.size(scores) - F.array_position(F.reverse(F.transform(scores, lambda x: x > 0)), F.lit(True))
        return F.least(let(uniform(row_id, seed), lambda drawn: below(scores, drawn)), last)

    return let(softmax(F.transform(kept, lambda x: x / temperature)), choose).cast("int")


def rms_normalize(vector: Column, epsilon: float = 1e-6) -> Column:
    def scale(wide: Column) -> Column:
        squares = F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x)
        root = F.sqrt(squares / F.size(wide) + epsilon)
        return let(root, lambda r: F.transform(wide, lambda x: x / r))

    return let(doubles(vector), scale)

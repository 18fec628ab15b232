"""Chat formatting of preference pairs: the common turns once as prompt, then both completions with a loss mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LAST = 2**63 - 1


def render(role: F.Column, text: F.Column) -> F.Column:
    """One turn as text; a null role is ``unknown``, a null text empty."""
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("unknown")), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit("<|end|>\n"))


def _side(turns: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    columns = [F.col(pair_col).alias("pair"), F.coalesce(F.col(turn_col).cast("long"), F.lit(_LAST)).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")]
    return turns.where(F.col(pair_col).isNotNull()).select(*columns)


def _signed(side: DataFrame, name: str) -> DataFrame:
    """What a side says at each turn, as a signature of its rows in any order."""
    line = render(F.col("role"), F.col("text"))
    return side.groupBy("pair", "turn").agg(F.struct(F.count(F.lit(1)), F.sum(F.xxhash64(line).cast("decimal(38,0)")), F.sum(F.crc32(line))).alias(name))


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, *, pair_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learner: str = "assistant",
) -> DataFrame:
    """Pairs of conversations as prompt and masked completions, one row per rendered turn.

    Returns ``pair_col``, part (prompt, chosen or rejected), turn, rendered, train.  The prompt is
    the longest common prefix of turns, given once; turns from the first that differs (or that one
    side lacks) make the completions.  train marks ``learner`` turns of completions; it is false
    throughout where the other side has no turns at all.  Sides that are equal give a prompt alone.

    Turns follow ``turn_col``; a null turn comes last, rows that repeat a turn belong to it together.
    Null roles and texts are rendered as ``unknown`` and empty.  Rows without a pair id can't be
    paired and are left out.  Further columns are ignored.  No conversation is gathered: each turn
    stays a row, so one of any length spreads over tasks.
    """
    a, b = (_side(t, pair_col, turn_col, role_col, text_col) for t in (chosen, rejected))
    both = _signed(a, "a").join(_signed(b, "b"), ["pair", "turn"], "full")
    differs = ~F.col("a").eqNullSafe(F.col("b"))
    fork = both.groupBy("pair").agg(F.min(F.when(differs, F.col("turn"))).alias("fork"), (F.count("a") * F.count("b") > 0).alias("paired"))
    line = render(F.col("role"), F.col("text"))

    def parts(side: DataFrame, name: str) -> DataFrame:
        joined = side.join(fork, "pair")
        ahead = F.coalesce(F.col("turn") < F.col("fork"), F.lit(True))
        part = F.when(ahead, F.lit("prompt")).otherwise(F.lit(name))
        train = ~ahead & F.col("paired") & F.coalesce(F.col("role") == learner, F.lit(False))
        rows = joined.select("pair", part.alias("part"), "turn", line.alias("rendered"), train.alias("train"))
        return rows if name == "chosen" else rows.where("part <> 'prompt'")

    every = parts(a, "chosen").union(parts(b, "rejected"))
    return every.select(F.col("pair").alias(pair_col), "part", F.when(F.col("turn") < _LAST, F.col("turn")).alias("turn"), "rendered", "train")


def mismatched(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learner: str = "assistant") -> DataFrame:
    """Rejected sides from conversations alone: each one's last answer is replaced by its neighbour's.

    Conversations 2k and 2k+1 are neighbours; where a neighbour has no answer it is the empty text.
    Conversations without an answer have no rejected side of their own and come back unchanged.
    """
    own = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).alias("t"), F.col(role_col).alias("r"), F.col(text_col).alias("x"))
    last = own.where(F.col("r") == learner).groupBy("c").agg(F.max(F.struct("t", "x")).alias("last"))
    other = last.select(F.when(F.col("c") % 2 == 0, F.col("c") + 1).otherwise(F.col("c") - 1).alias("c"), F.col("last.x").alias("swap"))
    joined = own.join(last.select("c", F.col("last.t").alias("at")), "c", "left").join(other, "c", "left")
    swapped = (F.col("t") == F.col("at")) & (F.col("r") == learner)
    text = F.when(swapped, F.coalesce("swap", F.lit(""))).otherwise(F.col("x"))
    return joined.select(F.col("c").alias(conv_col), F.col("t").alias(turn_col), F.col("r").alias(role_col), text.alias(text_col))

"""Token and frame budgets, as Column expressions, and budgets of many videos by a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import bound
from ..functions.text import resolution
from .controls import even_floor

#: Fixed values of the budget rules: context, reserved for text, reserved for the answer, most visual tokens.
CONTEXT, TEXT, ANSWER, VISUAL = 32768, 2048, 512, 24000
#: Audio tokens a second, tokens around audio, seconds of audio at most.
AUDIO_RATE, AUDIO_FRAME, AUDIO_SECONDS = 25, 64, 300
#: Frames a second, frames at most, tokens of a frame at least.
FRAME_RATE, FRAMES, FRAME_TOKENS = 2, 300, 100


def allocation(weights: Column, amount: Column, least: int = 1, unit: int = 1) -> Column:
    """Whole shares of ``amount`` by weight, each ``least`` at least, in multiples of ``unit``; what is left goes to the greatest remainders, the first of equal ones.

    Null where there is not enough for the least shares.
    """
    n, whole = F.size(weights), F.floor(amount / unit)
    free = whole - n * least
    sum_ = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    exact = F.transform(weights, lambda w: free * w / sum_)
    given = F.transform(exact, lambda x: F.floor(x + 1e-9))
    left = free - F.aggregate(given, F.lit(0).cast("long"), lambda a, x: a + x)
    order = F.transform(F.array_sort(F.transform(exact, lambda x, i: F.struct(F.round(-(x - F.floor(x + 1e-9)), 9).alias("r"), i.alias("i")))), lambda x: x["i"])
    shares = F.transform(given, lambda g, i: (g + least + F.when(F.array_position(order, i) <= left, 1).otherwise(0)) * unit)
    return F.when((free >= 0) & (sum_ > 0), shares)


def audio_tokens(seconds: Column, capped: bool = True) -> Column:
    heard = F.least(seconds, F.lit(float(AUDIO_SECONDS))) if capped else seconds
    return (F.ceil(heard * AUDIO_RATE) + AUDIO_FRAME).cast("long")


def visual_tokens(audio: Column) -> Column:
    return F.least(F.lit(VISUAL), F.lit(CONTEXT - TEXT - ANSWER) - audio)


def frames(seconds: Column, visual: Column) -> Column:
    """An even number of frames that the rate, the most and the visual tokens allow; two at least."""
    most = F.least(seconds * FRAME_RATE, F.lit(float(FRAMES)), visual / FRAME_TOKENS)
    return F.greatest(F.lit(2), even_floor(most))


def grid(tokens: Column, ratio: Column, most: int = 48) -> Column:
    """(h, w): the patch grid nearest to a ratio (width by height) and to a number of tokens it may not pass, by ratio error plus four times the product's."""

    def tried(h: Column) -> Column:
        w = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(tokens / h), F.round(h * ratio).cast("long"))).cast("int")
        error = F.abs(w / h - ratio) / ratio + 4 * F.abs(tokens - w * h) / tokens
        return F.struct(F.round(error, 9).alias("error"), h.alias("h"), w.alias("w"))

    options = F.filter(F.transform(F.sequence(F.lit(1), F.lit(most)), tried), lambda x: x["h"] * x["w"] <= tokens)
    best = F.array_min(options)
    return F.struct(best["h"].alias("h"), best["w"].alias("w"))


def proportional(amount: Column, durations: Column) -> Column:
    """Parts of an amount in proportion to durations."""
    whole = F.aggregate(durations, F.lit(0.0), lambda a, x: a + x)
    return F.transform(durations, lambda d: amount * d / whole)


#: Tokens of a frame at most, pixels of a token's side, tokens kept free (fixed values of the budget rules).
FRAME_MOST, PATCH, HEADROOM = 128, 28, 512


def fitted_grid(tokens: Column, ratio: Column) -> Column:
    """(h, w): the grid of tokens for two frames that fits a ratio (width by height) and a number of tokens best.

    The error is the ratio's logarithm plus four times the share of tokens
    left over; ties go to the better ratio, the larger grid, the lesser
    height.  Every height is tried with the widths next to the ratio and the
    three largest; grids below 100 tokens a frame are out, unless fewer are
    allowed.  Where none is left, the grid nearest to a square root.
    """

    def fitted(v: Column) -> Column:
        tokens, ratio, least = v["tokens"], v["ratio"], v["least"]

        def of_height(h: Column) -> Column:
            def widths(most: Column) -> Column:
                near = lambda w: F.greatest(F.lit(1), F.least(most, w.cast("int")))
                return F.array_distinct(F.array(near(F.floor(ratio * h)), near(F.ceil(ratio * h)), near(most), near(most - 1), near(most - 2)))

            def tried(w: Column) -> Column:
                made = lambda off: F.struct(F.round(off + 4 * (tokens - h * w) / tokens, 9).alias("score"), F.round(off, 9).alias("off"), (-h * w).alias("size"), h.alias("h"), w.alias("w"))
                return bound(F.abs(F.log(w / h / ratio)), made)

            return F.transform(F.filter(bound(F.floor(tokens / h).cast("int"), widths), lambda w: (h * w).between(least, tokens)), tried)

        best = F.array_min(F.flatten(F.transform(F.sequence(F.lit(1), tokens), of_height)))
        height = F.greatest(F.lit(1), F.floor(F.sqrt(tokens / ratio)).cast("int"))
        width = F.greatest(F.lit(1), F.least(F.floor(tokens / height).cast("int"), F.round(ratio * height).cast("int")))
        return bound(best, lambda b: F.when(b.isNotNull(), F.struct(b["h"].alias("h"), b["w"].alias("w"))).otherwise(F.struct(height.alias("h"), width.alias("w"))))

    ratio, tokens = F.greatest(ratio.cast("double"), F.lit(1e-6)), tokens.cast("int")
    least = F.greatest(F.lit(4), F.least(tokens, F.lit(2 * FRAME_TOKENS)))
    return bound(F.struct(tokens.alias("tokens"), ratio.alias("ratio"), least.alias("least")), fitted)


_BUDGET = "struct<frames:bigint,height:int,width:int,audio:bigint,visual_budget:bigint,visual:bigint,checked:bigint,fault:string>"


def _video_plan(seconds: Column, size: Column) -> Column:
    """(audio, visual, frames, pair, ratio): tokens of the audio, left for frames, frames, and what their grid hangs on, tokens of two frames and a ratio; frames, pair and ratio are null without a visual budget, all without a duration."""

    def planned(b: Column) -> Column:
        n = F.when(b["visual"] > 0, even_floor(F.least(F.least(seconds * FRAME_RATE, F.lit(float(FRAMES))), b["visual"] / FRAME_TOKENS)))

        def paired(n: Column) -> Column:
            pair = F.when(n.isNotNull(), F.greatest(F.lit(4), F.least(F.lit(2 * FRAME_MOST), F.floor(b["visual"] * 2 / n))).cast("int"))
            ratio = F.when(n.isNotNull(), b["r"]["width"] / b["r"]["height"])
            return F.struct(b["audio"].alias("audio"), b["visual"].alias("visual"), n.alias("frames"), pair.alias("pair"), ratio.alias("ratio"))

        return bound(n, paired)

    audio = audio_tokens(seconds)
    free = F.struct(audio.alias("audio"), F.least(F.lit(VISUAL), F.lit(CONTEXT - TEXT - HEADROOM) - audio).cast("long").alias("visual"), resolution(size).alias("r"))
    return F.when(F.coalesce(seconds > 0, F.lit(False)), bound(free, planned))


def _video_made(plan: Column, grid_: Column) -> Column:
    """The budget of a plan whose grid is known."""
    used = (plan["frames"] / 2).cast("long") * grid_["h"] * grid_["w"]
    checked = TEXT + plan["audio"] + used + HEADROOM
    good = F.struct(
        plan["frames"].alias("frames"), (grid_["h"] * PATCH).alias("height"), (grid_["w"] * PATCH).alias("width"), plan["audio"].alias("audio"), plan["visual"].alias("visual_budget"), used.alias("visual"), checked.alias("checked"),
        F.when(checked > CONTEXT, "beyond the context").alias("fault"),
    )
    none = lambda fault: F.from_json(F.lit(f'{{"fault": "{fault}"}}'), _BUDGET)
    return F.when(plan.isNull(), none("no duration")).when(plan["frames"].isNull(), none("no visual budget")).otherwise(good.cast(_BUDGET))


def video_budget(seconds: Column, size: Column) -> Column:
    """(frames, height, width, audio, visual_budget, visual, checked, fault) of a video of so many seconds and a size such as 640x360.

    Faults: no duration, no visual budget, and beyond the context; sizes that
    cannot be read are 16 by 9.  The grid is searched row by row; for many
    rows see :func:`with_video_budgets`.
    """
    made = lambda b: bound(fitted_grid(b["pair"], b["ratio"]), lambda g: _video_made(b, g))
    return bound(_video_plan(seconds, size), made)


def with_video_budgets(videos: DataFrame, seconds: Column, size: Column, name: str = "budget") -> DataFrame:
    """``videos`` with :func:`video_budget` as a column.

    Each duration and size is read once, and as a grid hangs on the tokens of
    two frames (253 numbers) and the ratio alone, each such pair is searched
    once; both are joined with their rows.
    """
    keyed = videos.withColumns({"__seconds": seconds, "__size": size})
    planned = keyed.select("__seconds", "__size").distinct().withColumn("__plan", _video_plan(F.col("__seconds"), F.col("__size"))).withColumns({"__pair": F.col("__plan.pair"), "__ratio": F.col("__plan.ratio")})
    grids = planned.select(F.col("__pair").alias("__p"), F.col("__ratio").alias("__r")).distinct().withColumn("__grid", fitted_grid(F.col("__p"), F.col("__r")))
    # Null-safe, as a plain join would test plans for null, and do that before rows are made distinct.
    made = planned.join(grids, F.col("__pair").eqNullSafe(F.col("__p")) & F.col("__ratio").eqNullSafe(F.col("__r")), "left").select(F.col("__seconds").alias("__s"), F.col("__size").alias("__z"), _video_made(F.col("__plan"), F.col("__grid")).alias(name))
    return keyed.join(made, F.col("__seconds").eqNullSafe(F.col("__s")) & F.col("__size").eqNullSafe(F.col("__z")), "left").drop("__seconds", "__size", "__s", "__z")

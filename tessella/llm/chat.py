"""Preference formatting: pairs of a chosen and a rejected conversation become one prompt and two masked completions.

The prompt is the longest common prefix of turns (equal roles and texts), rendered once. Each completion is the rest
of its conversation with the character ranges that a trainer may learn from: the assistant's turns and their end
marks. Turns are rendered as START role newline text END newline; marks inside texts are broken up, so that a text
can't end its turn.

Conversations of one first turn are natural pairs. For one without a natural partner a view makes the rejected branch:
its own turns up to its last assistant turn, which is replaced by the last assistant turn of another conversation. The
prompt is then what precedes that turn, the same in both branches.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.llm.common import map_batches, shared, table

#: The marks of a turn, and the role that is learned.
START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"
#: Parts, by a hash of the id, that the conversations of a first turn are counted in; parts that a frequent answer is
#: dealt to in a join; and distinct answers in a ring of donors.
PARTS, SALTS, AT_ONCE = 1024, 8, 1000
#: Following answers that the conversations of one answer take their rejected ones from.
DONORS = 8

Turn = tuple[str | None, str | None]


def render(turn: Turn) -> tuple[str, int, int]:
    """A rendered turn, and where its content and end mark lie in it."""
    role, text = turn
    head = f"{START}{clean(role or 'user')}\n"
    body = head + clean(text or "") + END
    return body + "\n", len(head), len(body)


def clean(s: str) -> str:
    return s.replace("<|", "<​|") if "<|" in s else s


def format_pair(chosen: list[Turn], rejected: list[Turn] | None) -> dict:
    """Prompt, completions and masks of a pair. Without a rejected conversation (None) the prompt is what precedes the
    chosen one's last assistant turn (all of it, if there is none), and the rejected completion is null.

    If one conversation is the beginning of the other, the prompt is that one as a whole and its completion empty; equal
    conversations are all prompt, which prefers nothing (`pairs` marks them).
    """
    if rejected is None:
        n = max((i for i, t in enumerate(chosen) if t[0] == LEARNED), default=len(chosen))
    else:
        n = 0
        while n < len(chosen) and n < len(rejected) and chosen[n] == rejected[n]:
            n += 1
    out: dict = {"prompt_turns": n, "prompt": "".join(render(t)[0] for t in chosen[:n])}
    for name, turns in (("chosen", chosen), ("rejected", rejected)):
        text, mask = "", []
        for t in (turns or [])[n:]:
            piece, a, b = render(t)
            if t[0] == LEARNED:
                mask.append({"start": len(text) + a, "end": len(text) + b})
            text += piece
        out[name] = None if turns is None else text
        out[f"{name}_mask"] = None if turns is None else mask
    return out


def branch(turns: list[Turn], donor: list[Turn]) -> list[Turn]:
    """`turns` up to the last assistant turn, and the donor's last assistant turn in its place."""
    last = lambda ts: max(i for i, t in enumerate(ts) if t[0] == LEARNED)
    return [*turns[: last(turns)], donor[last(donor)]]


def conversations(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, opening) from rows (conv_id, turn, role, text): a conversation's turns in order (ties by
    role and text; rows that repeat a turn number stay as turns of their own, null numbers come first) and a hash of
    its first turn. Rows without a conv_id are left out: nothing tells what they belong to."""
    one = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    c = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("t"))
    c = c.select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    return c.withColumn("opening", F.md5(F.to_json(F.element_at("turns", 1), {"ignoreNullFields": "false"})))


def pairs(c: DataFrame, better: Column | None = None) -> DataFrame:
    """Rows (chosen_id, rejected_id, same): conversations of the same opening, two by two in order of (part, id), where an
    id's part is one of PARTS by its hash; the one with more learned characters is chosen (then the smaller id). The last
    of an odd number has no rejected one. `same` says that both are rendered alike, so that the pair prefers nothing; it is
    null without a rejected one.

    A place is the number of rows in the parts before, from their counts, and the place within the part, so a frequent
    opening is no single task's work and the rule is the same for any number of conversations.
    """
    score = better if better is not None else F.aggregate("turns", F.lit(0), lambda a, t: a + F.when(t["role"] == LEARNED, F.length(t["text"])).otherwise(0))
    slim = shared(c.select("conv_id", "opening", F.coalesce(score, F.lit(0)).alias("score"), whole().alias("whole"), F.pmod(F.xxhash64("conv_id"), F.lit(PARTS)).cast("int").alias("part")))
    before = F.coalesce(F.sum("n").over(W.partitionBy("opening").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = slim.groupBy("opening", "part").agg(F.count("*").alias("n")).withColumn("before", before).drop("n")
    place = F.col("before") + F.row_number().over(W.partitionBy("opening", "part").orderBy("conv_id")) - 1
    placed = slim.join(counts, ["opening", "part"]).withColumn("pair", F.floor(place / 2))
    both = placed.groupBy("opening", "pair").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("conv_id").alias("id"), "whole"))).alias("x"))
    first, second = F.get("x", 0), F.get("x", 1)
    return both.select(first["id"].alias("chosen_id"), second["id"].alias("rejected_id"), (first["whole"] == second["whole"]).alias("same"))


def cleaned(text: Column) -> Column:
    """A text as `render` writes it."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit(clean("<|")))


def whole() -> Column:
    """A hash of a conversation as it is rendered."""
    return F.md5(F.to_json(F.transform("turns", lambda t: F.struct(cleaned(F.when(t["role"] != "", t["role"]).otherwise("user")).alias("role"), cleaned(t["text"]).alias("text")))))


def donors(c: DataFrame) -> DataFrame:
    """Rows (conv_id, donor_id): for each conversation with an assistant turn another one that ends with a different
    answer (last assistant turn). Distinct answers form rings of about AT_ONCE in order of their hashes; the holders of
    an answer are dealt to the DONORS that follow it, each the least id of its answer. Without a second answer in the
    table there is no donor, thus no row.
    """
    answers = F.filter("turns", lambda t: t["role"].eqNullSafe(LEARNED))
    said = shared(c.select("conv_id", answers.alias("a")).filter(F.size("a") > 0).select("conv_id", F.md5(cleaned(F.element_at("a", -1)["text"])).alias("said")))
    distinct = shared(said.groupBy("said").agg(F.min("conv_id").alias("donor")))
    rings = max(1, distinct.count() // AT_ONCE)
    ring = distinct.groupBy(F.pmod(F.xxhash64("said"), F.lit(rings)).alias("ring")).agg(F.sort_array(F.collect_list(F.struct("said", "donor"))).alias("xs")).filter(F.size("xs") > 1)
    following = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(DONORS), F.size("xs") - 1)), lambda k: F.get("xs", F.pmod(i + k, F.size("xs")))["donor"])
    next_ones = ring.select(F.inline(F.transform("xs", lambda x, i: F.struct(x["said"].alias("said"), following(i).alias("next")))))
    # A frequent answer is dealt to SALTS parts, as a frequent opening is.
    salted = next_ones.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = said.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int")).join(salted, ["said", "salt"])
    return met.select("conv_id", F.get("next", F.pmod(F.xxhash64("conv_id", F.lit(1)), F.size("next")).cast("int")).alias("donor_id"))


def with_branches(c: DataFrame, p: DataFrame) -> DataFrame:
    """Rows (chosen_id, rejected_id, made): the natural pairs of `p`, and for each conversation that is in none (it has
    no partner or one that is rendered alike) the id of its donor, or null."""
    natural = F.coalesce(~F.col("same"), F.lit(False))
    p = shared(p)
    alone = p.filter(~natural).select(F.explode(F.array_compact(F.array("chosen_id", "rejected_id"))).alias("chosen_id"))
    made = alone.join(donors(c).withColumnsRenamed({"conv_id": "chosen_id", "donor_id": "rejected_id"}), "chosen_id", "left")
    return p.filter(natural).select("chosen_id", "rejected_id", F.lit(False).alias("made")).unionByName(made.withColumn("made", F.col("rejected_id").isNotNull()))


TURNS = "array<struct<role:string,text:string>>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
RESULT = "chosen_id long, rejected_id long, prompt_turns long, prompt string, chosen string, chosen_mask array<struct<start:bigint,end:bigint>>, rejected string, rejected_mask array<struct<start:bigint,end:bigint>>, made boolean"


def format_preferences(c: DataFrame, p: DataFrame) -> DataFrame:
    """Rows of RESULT from conversations (conv_id, turns) and pairs (chosen_id, rejected_id or null), one for each pair.
    Where `p` has a true column `made`, the rejected one is the `branch` of the chosen one with the other as its donor.

    Masks are character ranges, end exclusive. A null role counts as user, a null text as empty.
    """
    own = c.select("conv_id", F.col("turns").cast(TURNS).alias("turns"))
    a = own.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("a"))
    b = own.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("b"))
    made = F.col("made") if "made" in p.columns else F.lit(False)
    joined = p.select("chosen_id", "rejected_id", made.alias("made")).join(a, "chosen_id").join(b, "rejected_id", "left").select("chosen_id", "rejected_id", "a", "b", "made")

    def make():
        def batch(x: pa.RecordBatch) -> pa.RecordBatch:
            as_list = lambda x, i: [None if v is None else [(t["role"], t["text"]) for t in v] for v in x.column(i).to_pylist()]
            sides = zip(as_list(x, 2), as_list(x, 3), x.column(4).to_pylist(), strict=True)
            rows = [format_pair(a, branch(a, b) if made else b) for a, b, made in sides]
            kinds = {"prompt_turns": pa.int64(), "prompt": pa.string(), "chosen": pa.string(), "chosen_mask": SPAN, "rejected": pa.string(), "rejected_mask": SPAN}
            return pa.RecordBatch.from_arrays([x.column(0), x.column(1), *(pa.array([r[k] for r in rows], t) for k, t in kinds.items()), x.column(4)], names=["chosen_id", "rejected_id", *kinds, "made"])

        return batch

    return map_batches(joined, make, RESULT)


def preference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of RESULT for all of `conversations`: the natural pairs, and a made pair for every other conversation with an
    assistant turn. Null roles, texts and turn numbers count as in `conversations` and `format_preferences`; copies are
    conversations of their own; an empty table gives an empty result."""
    c = shared(conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")))
    return format_preferences(c, with_branches(c, pairs(c)))

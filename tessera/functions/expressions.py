"""Column expressions: durations, paths, token ids, arrays of logits. All are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: clock rates in Hz and cycles per frame of the two television standards
PAL_HZ, PAL_CYCLES = 985248, 19656
NTSC_HZ, NTSC_CYCLES = 1022727, 17095


def duration_seconds(token: Column) -> Column:
    """Seconds of `[H:]M:S[.mmm]`; what follows the first dot is whole milliseconds."""
    whole = F.split(F.split_part(token, F.lit("."), F.lit(1)), ":")
    seconds = F.aggregate(whole, F.lit(0).cast("long"), lambda a, x: a * 60 + x.cast("long"))
    at = F.instr(token, ".")
    millis = F.when(at > 0, F.substr(token, at + 1).cast("double") / F.lit(1000.0)).otherwise(F.lit(0.0))
    return seconds.cast("double") + millis


def frame_budget(seconds: Column, ntsc: bool = False) -> Column:
    """Whole frames in seconds: cycles are cut to a whole number first, then divided."""
    hz, cycles = (NTSC_HZ, NTSC_CYCLES) if ntsc else (PAL_HZ, PAL_CYCLES)
    return F.floor(F.floor(F.lit(float(hz)) * seconds) / F.lit(cycles)).cast("long")


def pick_time(times: Column, subtune: Column) -> Column:
    """The subtune-th time, counted from 1; null where there is none."""
    return F.when(subtune >= 1, F.try_element_at(times, subtune))


def block_path(sid_path: Column, subtune: Column) -> Column:
    base = F.when(sid_path.endswith(".sid"), F.substr(sid_path, F.lit(1), F.length(sid_path) - 4)).otherwise(sid_path)
    return F.concat(base, F.lit("."), subtune.cast("string"), F.lit(".blocks.npy"))


def resolve(relpath: Column, root: str) -> Column:
    """relpath below root; an absolute path, or any path under an empty root, stays as it is."""
    if not root:
        return relpath
    return F.when(relpath.startswith("/"), relpath).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), relpath))


def path_suffix(path: Column, p: Column) -> Column:
    """path with `.p` before its last extension where p > 0; without an extension, at its end."""
    with_ext = F.regexp_replace(path, F.lit(r"^(.*[^/])(\.[^./]+)$"), F.concat(F.lit("$1."), p.cast("string"), F.lit("$2")))
    named = F.when(F.regexp_like(path, F.lit(r"[^/]\.[^./]+$")), with_ext).otherwise(F.concat(path, F.lit("."), p.cast("string")))
    return F.when(p > 0, named).otherwise(path)


def encode(ids: Column) -> Column:
    """Program ids to model ids: 0 is left for padding."""
    return F.transform(ids, lambda x: x + 1)


def decode(ids: Column, vocab: int) -> Column:
    """Model ids to program ids; padding and what is out of range goes, wherever it is."""
    return F.transform(F.filter(ids, lambda x: (x >= 1) & (x <= vocab)), lambda x: x - 1)


def token_label(model_id: Column, ranges: list[tuple[str, int, int, str]]) -> Column:
    """The label of a model id by ranges (kind, first, last, template) of program ids.

    A template may hold {n}, the place in the range, or {d}, a signed distance from its middle.
    """
    pid = model_id - 1
    out = F.when(model_id == 0, F.lit("PAD"))
    for _, first, last, template in ranges:
        if "{d}" in template:
            text = F.format_string(template.replace("{d}", "%+d"), (pid - (first + last) / 2).cast("int"))
        elif "{n}" in template:
            text = F.format_string(template.replace("{n}", "%d"), (pid - first).cast("int"))
        else:
            text = F.lit(template)
        out = out.when((pid >= first) & (pid <= last), text)
    return out.otherwise(F.concat(F.lit("RESERVED_"), pid.cast("string")))


def xy(block: Column) -> tuple[Column, Column]:
    """Inputs and targets of a block: all but the last token, all but the first."""
    n = F.size(block) - 1
    return F.slice(block, 1, n).cast("array<bigint>"), F.slice(block, 2, n).cast("array<bigint>")


def real_tokens(block: Column) -> Column:
    return F.filter(block, lambda x: x > 0)


def argmax(values: Column) -> Column:
    """The place, from 0, of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def top_k(logits: Column, k: int, temperature: float = 1.0) -> Column:
    """array<struct<id int, p double>>: the k largest of logits (the first of equal ones first) and
    the chance of each after a softmax over them at the temperature."""
    ranked = F.transform(logits, lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("i")))
    best = F.slice(F.sort_array(ranked, asc=False), 1, k)
    weight = lambda x: F.exp((x["v"] - F.array_max(logits).cast("double")) / temperature)
    total = F.aggregate(best, F.lit(0.0), lambda a, x: a + weight(x))
    return F.transform(best, lambda x: F.struct((-x["i"]).cast("int").alias("id"), (weight(x) / total).alias("p")))


def choose_token(logits: Column, temperature: float, *key: Column, k: int | None = None, seed: int = 0) -> Column:
    """The id that is drawn from the softmax of logits at the temperature, among the k largest (the
    first of equal ones first; all, if not given). At temperature 0 it is the first largest.

    To each logit is added noise (Gumbel's) from a hash of key, seed and id, and the largest sum is taken;
    so the choice is the same anywhere, and as random as the hash. key should tell rows and steps apart.
    """
    if temperature < 0:
        raise ValueError("the temperature must not be negative")
    if temperature == 0 or k == 1:
        return argmax(logits)
    ranked = F.transform(logits, lambda v, i: F.struct(v.cast("double").alias("v"), (-i).alias("i")))
    best = F.slice(F.sort_array(ranked, asc=False), 1, k) if k else ranked
    name = F.concat_ws("|", *(c.cast("string") for c in key), F.lit(str(seed)))

    def noise(i: Column) -> Column:
        number = F.conv(F.substring(F.md5(F.concat_ws("|", name, i.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
        return -F.log(-F.log((number + 0.5) / F.lit(2.0**32)))

    summed = F.transform(best, lambda x: F.struct((x["v"] / temperature + noise(-x["i"])).alias("s"), x["i"].alias("i")))
    return (-F.array_max(summed)["i"]).cast("int")


def cross_entropy(logits: Column, target: Column, smoothing: float = 0.0) -> Column:
    """-log softmax at target, with the largest logit taken off first; smoothing spreads that
    share of the target over all classes."""
    top = F.array_max(logits)
    lse = top + F.log(F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp((x - top).cast("double"))))
    own = lse - F.element_at(logits, target + 1)
    if not smoothing:
        return own
    spread = lse - F.aggregate(logits, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(logits)
    return (1 - smoothing) * own + smoothing * spread


def overlap_accuracy(truth: Column, pred: Column) -> Column:
    """The share of equal elements over the shorter array's length; 0 where that is 0."""
    n = F.least(F.size(truth), F.size(pred))
    same = F.size(F.filter(F.zip_with(F.slice(truth, 1, n), F.slice(pred, 1, n), lambda a, b: a == b), lambda x: x))
    return F.when(n > 0, same / n).otherwise(F.lit(0.0))

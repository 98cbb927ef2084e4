"""Three-band spans: sentence scores, ratios by length, merged spans, perplexity and fusion of layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import text as T
from quillstone.functions.lexicon import Lexicon

#: Labels begin at these risks; composite labels at these shares; official labels at these percentages.
AI, SUSPECTED = 62, 38
COMPOSITE_AI, COMPOSITE_SUSPECTED = 40, 20
OFFICIAL_AI, OFFICIAL_SUSPECTED = 60, 30
BASE = 22


def span_table(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, sent_idx, sent, start, end): sentences with half-open offsets in code points; those of marks alone are left out."""
    return docs.select("doc_id", F.posexplode(cut(lexicon)).alias("sent_idx", "_s")).select("doc_id", "sent_idx", "_s.*")


def pieces(lexicon: Lexicon) -> Column:
    return T.pieces(F.coalesce("text", F.lit("")), lexicon.span_delimiters)


def worded(sent: Column, lexicon: Lexicon) -> Column:
    """Whether a sentence is more than marks and white space."""
    return sent.rlike(f"[^{lexicon.span_delimiters}{lexicon.ignore}{T.SPACES}]")


def cut(lexicon: Lexicon) -> Column:
    """Sentences of text as structs (sent, start, end). Sentences are neighbours in the text, so a sentence's end is the sum of the
    lengths so far: lengths are packed into one sorted pass of numbers, not summed anew for each sentence."""
    def placed(p: Column) -> Column:
        ends = T.running_sum(F.transform(p, F.length))
        return T.let(ends, lambda e: F.transform(p, lambda s, i: F.struct(s.alias("sent"), (F.get(e, i) - F.length(s)).alias("start"), F.get(e, i).alias("end"))))

    return F.filter(T.let(pieces(lexicon), placed), lambda x: worded(x.sent, lexicon))


def span_rules(s: Column, n: Column, vague: Column, lexicon: Lexicon) -> list[tuple[str, Column, int]]:
    """Rules of a sentence s of n visible characters; vague: whether its subject is."""
    return [
        ("formulaic", T.any_of(s, lexicon.formulaic), 30),
        ("official", T.any_of(s, lexicon.official), 16),
        ("outline head", s.rlike(f"^ *{T.alternation(lexicon.skeleton)}"), 28),
        ("connective head", s.rlike(f"^ *(?:{lexicon.wide_connective_heads})"), 18),
        ("abstract nouns", (n > 22) & s.rlike(lexicon.abstract), 12),
        ("very long", n >= 38, 14),
        ("long", (n >= 28) & (n < 38), 6),
        ("row of idioms", s.rlike(lexicon.long_idioms), 14),
        ("mixed spacing", s.rlike(lexicon.mixed_spacing), 12),
        ("judgement tail", (n > 20) & s.rlike(lexicon.span_judgement_tail), 10),
        ("triple", s.rlike(lexicon.triple), 14),
        ("vague subject", vague, 10),
        ("modal", T.count(s, lexicon.span_modal) >= 2, 8),
        ("personal view", ~vague & s.rlike(lexicon.personal), -20),
        ("concrete detail", s.rlike(lexicon.concrete), -12),
        ("colloquial", s.rlike(lexicon.colloquial), -10),
        ("short", n <= 12, -16),
        ("question", s.rlike(lexicon.question), -8),
        ("pause", s.rlike(lexicon.pause), -6),
    ]


def label_of(risk: Column) -> Column:
    return F.when(risk >= AI, "ai").when(risk >= SUSPECTED, "suspected").otherwise("human")


def scored_spans(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Sentences of docs with risk, reasons, label and weight. A sentence's length and the verdicts of its rules are made once."""
    df = T.once(span_table(docs, lexicon), _n=T.visible_length("sent"), _vague=F.col("sent").rlike(lexicon.vague))
    rules = span_rules(F.col("sent"), F.col("_n"), F.col("_vague"), lexicon)
    df = T.once(df, **{f"_r{k}": holds for k, (_, holds, _) in enumerate(rules)})
    reasons = F.array_compact(F.array(*(F.when(F.col(f"_r{k}"), name) for k, (name, _, _) in enumerate(rules))))
    total = sum((F.when(F.col(f"_r{k}"), points).otherwise(0) for k, (_, _, points) in enumerate(rules)), F.lit(BASE))
    df = df.select("doc_id", "sent_idx", "sent", "start", "end", reasons.alias("reasons"), T.clamp(total, 0, 100).cast("int").alias("risk"), F.greatest(F.lit(1), "_n").alias("weight"))
    return df.select("doc_id", "sent_idx", "sent", "start", "end", "reasons", "risk", label_of(F.col("risk")).alias("label"), "weight")


def ratios(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Shares of a document's length under each label, in percent, and the composite and its label."""
    share = lambda label: F.sum(F.when(F.col("label") == label, F.col("weight")).otherwise(0)) * 100 / F.sum("weight")
    out = scored_spans(docs, lexicon).groupBy("doc_id").agg(*(share(x).alias(f"{x}_share") for x in ("ai", "suspected", "human")), F.count("*").alias("n"))
    return composite(out)


def composite(shares: DataFrame) -> DataFrame:
    """shares (ai_share, suspected_share) with composite and composite_label."""
    out = shares.withColumn("composite", F.col("ai_share") + 0.5 * F.col("suspected_share"))
    label = F.when(F.col("composite") >= COMPOSITE_AI, "ai").when(F.col("composite") >= COMPOSITE_SUSPECTED, "suspected").otherwise("human")
    return out.withColumn("composite_label", label)


def merged_spans(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """Runs of neighbouring sentences of one label, human ones left out: island, from, to, start, end, label, mean risk."""
    by = Window.partitionBy("doc_id").orderBy("sent_idx")
    scored = scored_spans(docs, lexicon).withColumn("turn", F.coalesce((F.col("label") != F.lag("label").over(by)).cast("int"), F.lit(0)))
    islands = scored.withColumn("island", F.sum("turn").over(by))
    out = islands.where("label <> 'human'").groupBy("doc_id", "island", "label")
    return out.agg(F.min("sent_idx").alias("first_idx"), F.max("sent_idx").alias("last_idx"), F.min("start").alias("start"), F.max("end").alias("end"), T.half_up(F.avg("risk")).cast("int").alias("risk"))


def top_spans(docs: DataFrame, lexicon: Lexicon, k: int = 8) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("risk"), "start"))
    return merged_spans(docs, lexicon).withColumn("rank", rank).where(F.col("rank") <= k)


# --- perplexity and layers ----------------------------------------------------------------------------------------------


def nll_windows(windows: DataFrame) -> DataFrame:
    """(doc_id, mean_nll, window_std, scored, windows, perplexity) of windows (doc_id, win, scored, mean_nll), which hold the mean
    negative log-likelihood of so many scored tokens; windows without tokens or a finite mean are left out."""
    good = windows.where((F.col("scored") > 0) & F.col("mean_nll").isNotNull() & ~F.isnan("mean_nll") & (F.abs("mean_nll") < float("inf")))
    out = good.groupBy("doc_id").agg((F.sum(F.col("mean_nll") * F.col("scored")) / F.sum("scored")).alias("mean_nll"), F.coalesce(F.stddev_samp("mean_nll"), F.lit(0.0)).alias("window_std"), F.sum("scored").alias("scored"), F.count("*").alias("windows"))
    return out.withColumn("perplexity", F.exp("mean_nll"))


def masked_nll(tokens: DataFrame, groups: int = 5) -> DataFrame:
    """tokens (doc_id, win, pos, logits, target, masked) to (doc_id, win, scored, mean_nll): log-sum-exp of the logits, shifted by
    their maximum, less the target's logit; mask_group is the round-robin group of a position."""
    top = F.array_max("logits")
    lse = top + F.log(F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top)))
    nll = lse - F.element_at("logits", F.col("target") + 1)
    scored = tokens.where("masked").withColumn("nll", nll).withColumn("mask_group", F.col("pos") % groups)
    return scored.where(~F.isnan("nll")).groupBy("doc_id", "win").agg(F.count("*").alias("scored"), F.avg("nll").alias("mean_nll"))


#: Fixed values of the perplexity layer.
LEAST_SCORED, FLAT_STD, LOW_NLL = 60, 0.12, 0.70


def perplexity_layer(aggregates: DataFrame) -> DataFrame:
    """aggregates of nll_windows with layer (0 to 100; null under the least number of scored characters) and issues."""
    flatness = F.when(F.col("windows") >= 3, T.clamp(1 - F.col("window_std") / 0.35)).otherwise(0.5)
    value = (0.7 * T.clamp((0.98 - F.col("mean_nll")) / 0.56) + 0.3 * flatness) * 100
    enough = F.col("scored") >= LEAST_SCORED
    issues = F.filter(F.array(F.when(enough & (F.col("mean_nll") < LOW_NLL), "low perplexity"), F.when(enough & (F.col("windows") >= 3) & (F.col("window_std") < FLAT_STD), "flat perplexity")), lambda x: x.isNotNull())
    return aggregates.withColumn("layer", F.when(enough, value)).withColumn("issues", issues)


def fuse_layers(layers: DataFrame, weight: float = 0.8) -> DataFrame:
    """layers (surface, semantic) with fused, divergence, fused_confidence."""
    out = layers.withColumn("fused", T.half_up((1 - weight) * F.col("surface") + weight * F.col("semantic")))
    out = out.withColumn("divergence", F.abs(F.col("surface") - F.col("semantic")))
    return out.withColumn("fused_confidence", T.half_up(T.clamp(92 - 0.52 * F.col("divergence"), 0, 100)))


def official_label(percent: Column) -> Column:
    return F.when(percent >= OFFICIAL_AI, "ai").when(percent >= OFFICIAL_SUSPECTED, "suspected").otherwise("human")

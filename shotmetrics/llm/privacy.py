"""Personal data: base patterns, and terms whose co-occurrence discloses an entity.

Base spans are emails, addresses, card and phone numbers. For the other words of
their documents the whole corpus is asked how strongly they reveal the entity:
pointwise mutual information of word and entity over distinct texts, as a share
of the entity's own information content. A word at or above the generalising
threshold is replaced by its kind, at or above the removing threshold it goes,
unless so many common texts may well be chance in a corpus of this size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shotmetrics.operators.lineage import checkpointed

from .shared import located, whole_text

# The base kinds in their order. Matching starts only where a run
# of the leading class starts, or where the last match ended, which finds the
# same leftmost matches in linear time; loops that nothing follows are possessive.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"[\p{L}\p{N}]{3,}+"

GENERALISE_AT = 0.8
REMOVE_AT = 0.95
# A term discloses only if its texts in common with the entity are at most this likely by chance.
CHANCE = 0.05
# How many common texts the bound of that chance multiplies, and which terms count as
# very common, one text in so many.
CHANCE_TEXTS = 8
COMMON = 100


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.ascii(F.substr(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(13, 19) & (_luhn(digits) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _entity(kind: str, value: Column) -> Column:
    """What the span names, whatever its spelling."""
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind in ("email", "ip") else _digits(value))


def base_spans(text: Column) -> Column:
    """array<struct<kind, start, end, entity>>, by kind as listed and then start."""

    def of(kind: str) -> Column:
        hits = F.filter(located(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        spans = F.transform(
            hits,
            lambda m: F.struct(
                F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), _entity(kind, m["value"]).alias("entity")
            ),
        )
        nothing = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,entity:string>>")
        return F.when(text.rlike(NEEDS[kind]), spans).otherwise(nothing)

    return F.concat(*[of(k) for k in KINDS])


def _masked(text: Column, spans: Column) -> Column:
    """The text with its spans as spaces; offsets stay."""

    def step(done: Column, span: Column) -> Column:
        at = F.greatest(done["at"], span["start"])
        end = F.greatest(done["at"], span["end"])
        upto = F.substr(text, done["at"] + 1, at - done["at"])
        return F.struct(end.alias("at"), F.concat(done["out"], upto, F.repeat(F.lit(" "), end - at)).alias("out"))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, start, step, lambda done: F.concat(done["out"], F.substr(text, done["at"] + 1, F.length(text))))


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), lambda w: F.lower(w)))


def _placed(masked: Column, actions: Column) -> Column:
    """Where the terms of a map from term to action stand: array<struct<start, end, action>>."""
    steps = F.zip_with(
        F.split(masked, TERM, -1),
        F.regexp_extract_all(masked, F.lit(TERM), F.lit(0)),
        lambda gap, value: F.struct(F.length(gap).alias("gap"), F.length(value).alias("size"), F.try_element_at(actions, F.lower(value)).alias("action")),
    )
    nothing = F.array().cast("array<struct<start:int,end:int,action:string>>")

    def place(done: Column, step: Column) -> Column:
        start = done["at"] + step["gap"]
        end = start + step["size"]
        hit = F.array(F.struct(start.alias("start"), end.alias("end"), step["action"].alias("action")))
        out = F.when(step["action"].isNotNull(), F.concat(done["out"], hit)).otherwise(done["out"])
        return F.struct(end.alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    return F.aggregate(F.filter(steps, lambda s: s["size"].isNotNull()), start, place, lambda done: done["out"])


def _share(joint: Column, term: Column, entity: Column, total: Column) -> Column:
    """Mutual information of term and entity over the entity's information content."""
    content = F.log(total / entity)
    return F.when(content > 0, F.log(joint * total / (term * entity)) / content).otherwise(F.lit(0.0))


def _chance(joint: Column, term: Column, entity: Column, total: Column) -> Column:
    """At most how likely that many common texts are if the term's texts are dealt at random.

    The expected number of sets of m texts in common over those of joint texts;
    exact where all texts of the term or of the entity are common and few.
    """

    def factor(done: Column, i: Column) -> Column:
        return done * (entity - i) * (term - i) / ((joint - i) * (total - i))

    return F.aggregate(F.sequence(F.lit(0), F.least(joint, F.lit(CHANCE_TEXTS)).cast("int") - 1), F.lit(1.0), factor)


def disclosing_terms(
    docs: DataFrame, found: DataFrame, generalise_at: float = GENERALISE_AT, chance: float = CHANCE
) -> DataFrame:
    """(text_key, term, share) for the terms that disclose an entity of the text, with the greatest share.

    Term and entity may stand anywhere in a text. All counts are over the
    distinct texts, so copies prove nothing. Only a term of at most total *
    (with_entity / total) ** generalise_at texts can reach the share; others are
    left out before pairs are formed. The entities of one text alone have equal
    counts and are paired as one.
    """
    marked = checkpointed(
        found.filter(F.size("spans") > 0)
        .dropDuplicates(["text_key"])
        .select(
            "text_key",
            F.array_distinct(F.transform("spans", lambda s: s["entity"])).alias("entities"),
            F.array_union(_words(F.col("text")), _words(_masked(F.col("text"), F.col("spans")))).alias("words"),
        )
    )
    total = found.select("text_key").distinct().agg(F.count("*").alias("total"))
    entities = marked.select("text_key", F.explode("entities").alias("entity"))
    counts = entities.groupBy("entity").agg(F.count("*").alias("with_entity"))
    most = F.col("total") * F.pow(F.col("with_entity") / F.col("total"), F.lit(generalise_at)) * (1 + 1e-9)
    own = F.when(F.col("with_entity") == 1, F.concat(F.lit("text:"), F.col("text_key").cast("string"))).otherwise(F.col("entity"))
    entities = checkpointed(
        entities.join(counts, "entity")
        .crossJoin(F.broadcast(total))
        .select("text_key", own.alias("entity"), "with_entity", "total", most.alias("most"))
        .distinct()
    )
    texts = docs.select(whole_text().alias("text")).withColumn("text_key", F.xxhash64("text")).dropDuplicates(["text_key"])
    known = checkpointed(texts.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term")))
    bound = entities.agg(F.max(F.greatest(F.col("most"), F.col("total") / COMMON)).alias("bound"))
    common = known.crossJoin(F.broadcast(bound)).filter(F.col("with_term") > F.col("bound")).select("term")
    words = marked.select("text_key", F.explode("words").alias("term")).join(F.broadcast(common), "term", "left_anti")
    words = words.join(known, "term", "left").fillna(1, ["with_term"])
    pairs = checkpointed(words.join(entities, "text_key").filter(F.col("with_term") <= F.col("most")))
    counted = pairs.groupBy("entity", "term", "with_term", "with_entity", "total").agg(F.count("*").alias("joint"))
    term = F.greatest("with_term", "joint")
    numbers = [F.col("joint"), term, F.col("with_entity"), F.col("total")]
    revealing = counted.filter(_chance(*numbers) <= chance).select("entity", "term", _share(*numbers).alias("share"))
    revealing = revealing.filter(F.col("share") >= generalise_at)
    return pairs.join(revealing, ["entity", "term"]).groupBy("text_key", "term").agg(F.max("share").alias("share"))


def personal_data(
    docs: DataFrame,
    generalise_at: float = GENERALISE_AT,
    remove_at: float = REMOVE_AT,
    chance: float = CHANCE,
) -> DataFrame:
    """Per row: doc_id, text_key, spans (base) and terms (array<struct<start, end, action>>).

    A null text counts as empty and has no spans. Rows sharing doc_id and text
    have equal results; text_key is a hash of the text that tells rows with one
    doc_id apart. An empty table gives an empty result; other columns are
    ignored.
    """
    text = docs.select("doc_id", whole_text().alias("text"))
    keyed = text.withColumn("text_key", F.xxhash64("text")).withColumn("spans", base_spans(F.col("text")))
    found = checkpointed(keyed.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))))
    revealing = disclosing_terms(docs, found, generalise_at, chance)
    action = F.when(F.col("share") >= remove_at, "remove").otherwise("generalise")
    actions = (
        revealing.groupBy("text_key")
        .agg(F.map_from_entries(F.collect_list(F.struct("term", action))).alias("actions"))
        .withColumnRenamed("text_key", "hit_key")
    )
    hits = found.filter(F.size("spans") > 0).join(actions, F.col("text_key") == F.col("hit_key"), "left")
    hits = hits.withColumn("text", _masked(F.col("text"), F.col("spans")))
    hits = hits.withColumn("terms", F.when(F.col("actions").isNotNull(), _placed(F.col("text"), F.col("actions"))))
    hits = hits.select("doc_id", "text_key", "spans", F.when(F.size("terms") > 0, F.col("terms")).alias("terms"))
    nothing = F.lit(None).cast("array<struct<start:int,end:int,action:string>>")
    rest = found.filter(F.size("spans") == 0).select("doc_id", "text_key", "spans", nothing.alias("terms"))
    return hits.unionByName(rest)


def sanitised(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with base spans replaced by their kind and disclosing terms generalised or removed.

    Of overlapping base spans the one that starts first is replaced, the longer
    of two that start together. A null text stays null; rows without spans
    keep their text; other columns, whatever their names, come back as given.
    """
    base = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("put")))
    terms = F.transform(
        F.coalesce("terms", F.array()),
        lambda t: F.struct(t["start"].alias("start"), (-t["end"]).alias("back"), F.when(t["action"] == "remove", "").otherwise("[TERM]").alias("put")),
    )
    cuts = found.select(
        F.col("doc_id").alias("_cut_id"), F.col("text_key").alias("_cut_key"), F.array_sort(F.concat(base, terms)).alias("_cuts")
    ).dropDuplicates(["_cut_id", "_cut_key"])
    # The row travels as one struct, so columns of any name (text_key, cuts, ...) cannot clash with these.
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("doc_id").alias("_doc_id"), F.col("text").alias("_text"))
    whole = F.coalesce(F.col("_text"), F.lit(""))
    rows = rows.withColumn("_key", F.xxhash64(whole))

    def step(done: Column, cut: Column) -> Column:
        fits = cut["start"] >= done["at"]
        upto = F.substr(whole, done["at"] + 1, cut["start"] - done["at"])
        return F.struct(
            F.when(fits, -cut["back"]).otherwise(done["at"]).alias("at"),
            F.when(fits, F.concat(done["out"], upto, cut["put"])).otherwise(done["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    text = F.aggregate("_cuts", start, step, lambda done: F.concat(done["out"], F.substr(whole, done["at"] + 1, F.length(whole))))
    same = F.col("_doc_id").eqNullSafe(F.col("_cut_id")) & (F.col("_key") == F.col("_cut_key"))
    replaced = F.when(F.col("_text").isNotNull(), text)
    joined = rows.join(cuts, same, "left")
    return joined.select(F.col("_row").withField("text", replaced).alias("_row")).select("_row.*")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts by kind and the digests of the span list, per row of personal_data()."""

    def listed(spans: Column, kind: Column | None = None) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", s["kind"] if kind is None else kind, s["start"], s["end"]))

    base = F.array_join(listed(F.col("spans")), ",")
    added = F.array_join(listed(F.coalesce("terms", F.array()), F.lit("term")), ",")
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[number(k) for k in KINDS],
        F.sha2(base, 256).alias("base_sha256"),
        F.concat_ws(",", F.when(base != "", base), F.when(added != "", added)).alias("spans"),
        F.coalesce(F.size("terms"), F.lit(0)).cast("bigint").alias("n_term"),
    )

"""Personal data: keyed surrogates of one type with what they stand for, as DataFrame expressions only.

Every entity gets one surrogate wherever it occurs, made from a keyed hash: a mail address looks like
one, a card number passes the check sum if the original does, a name keeps gender and script, digits,
letters and separators keep their places. No two entities share a surrogate, and none is an entity of
the data: candidates that collide are drawn again until none does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import query, table
from labelspark.session import materialize

#: Forms of address before a name (fixed values).
MALE = "Mr|Herr|Señor|Sr|Monsieur|Signor|господин|κύριος"
FEMALE = "Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Signora|госпожа|κυρία"
#: Kinds of entity and their patterns, in order of precedence (fixed values).
PATTERNS = {
    "email": r"(?<![A-Za-z0-9_%+.-])[A-Za-z0-9_%+-]++(?:\.[A-Za-z0-9_%+-]++)*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "secret": r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}"
          r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9])"
             r"|(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])"
             r"|(?<![0-9A-Za-z-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])",
    "name": rf"(?<!\p{{L}})(?:{MALE}|{FEMALE})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without this holds no entity.
HINT = rf"[0-9@]|(?:{MALE}|{FEMALE})\.? \p{{Lu}}|[A-Fa-f]{{32}}"
#: Syllables of drawn names by script (fixed values).
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga go ka ke ki la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se "
             "si so ta te ti to va ve vi za".split(),
    "cyrillic": "ба бе би бо ва ве ви га го да де ди за зо ка ке ки ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро "
                "са се си со та те ти то фа фе".split(),
    "greek": "βα βε βι γα γο δα δε δι ζα ζο θα θε κα κε κι λα λε λι λο μα με μι μο να νε νι νο πα πε ρα ρε ρι ρο σα σε σι "
             "σο τα τε τι το φα φε".split(),
}
#: Endings of drawn names by script and part (fixed values).
ENDINGS = {
    "latin": {"m": ["n", "r", "s"], "f": ["na", "la", "ra"], "s": ["lt", "nd", "rk"]},
    "cyrillic": {"m": ["н", "р", "с"], "f": ["на", "ла", "ра"], "s": ["нко", "рук", "лич"]},
    "greek": {"m": ["νος", "ρος", "λος"], "f": ["να", "λη", "ρα"], "s": ["κου", "λου", "νου"]},
}


def kind_of(mention: Column) -> Column:
    """The kind of a mention: the first pattern that fits it whole."""
    made = F.lit("name")
    for kind, pattern in reversed([(k, p) for k, p in PATTERNS.items() if k != "name"]):
        made = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(made)
    return made


def normal(kind: Column, part: Column) -> Column:
    """What mentions of one entity have in common: letters without case, numbers without separators."""
    return F.when(
        kind.isin("phone", "card", "iban", "ssn"), F.upper(F.regexp_replace(part, r"[^0-9A-Za-z]", ""))
    ).otherwise(F.lower(part))


def _number(digest: Column, at: int, modulus: int) -> Column:
    """A number below ``modulus`` from seven hex digits of a digest."""
    return F.conv(F.substring(digest, at + 1, 7), 16, 10).cast("long") % modulus


def _redrawn(text: Column, digest: Column, skip: int) -> Column:
    """Upper-case letters and digits after the first ``skip`` characters drawn anew."""
    def drawn(c: Column, i: Column) -> Column:
        value = F.conv(F.substring(F.md5(F.concat(digest, i.cast("string"))), 1, 7), 16, 10).cast("int")
        return (
            F.when(i < skip, c).when(c.rlike("^[0-9]$"), (value % 10).cast("string"))
            .otherwise(F.char((value % 26 + 65).cast("long")))
        )

    return F.array_join(F.transform(F.split(text, ""), drawn), "")


def _luhn(digits: Column) -> Column:
    """The check sum of a digit string, 0 if it holds."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
            i % 2 == 1, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)).otherwise(d.cast("int"))),
        F.lit(0), lambda a, d: a + d,
    ) % 10


def candidate(kind: Column, entity: Column, key: str, attempt: Column) -> Column:
    """The surrogate of an entity's normal form at one attempt.

    A name's kind is ``name:script:part``, the part m (given, male), f (given, female) or s (family).
    """
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string")), 256)
    email = F.concat(
        F.lit("user."), F.substring(digest, 1, 12), F.lit("@mail"), _number(digest, 12, 100).cast("string"),
        F.lit(".example."), F.regexp_extract(entity, r"\.([a-z]{2,})$", 1),
    )
    secret = F.substr(F.concat(digest, digest), F.lit(1), F.length(entity))
    ip = F.concat_ws(".", *[(_number(digest, 8 * i, 254) + 1).cast("string") for i in range(4)])
    drawn = _redrawn(entity, digest, 1)
    body = F.substr(drawn, F.lit(1), F.length(drawn) - 1)
    check = ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    card = F.when(_luhn(entity) == 0, F.concat(body, check)).otherwise(drawn)

    def name(script: str, part: str) -> Column:
        syllables, endings = F.array(*map(F.lit, SYLLABLES[script])), F.array(*map(F.lit, ENDINGS[script][part]))
        parts = [F.element_at(syllables, (_number(digest, 7 * i, len(SYLLABLES[script])) + 1).cast("int")) for i in range(5)]
        # More syllables with each attempt, so that there are always names left.
        more = [F.when(attempt > 3 * i, p).otherwise(F.lit("")) for i, p in enumerate(parts[3:])]
        tail = F.when(attempt > 6, F.translate(F.substring(digest, 50, 10), "0123456789abcdef", "".join(
            SYLLABLES[script][i][0] for i in range(0, 32, 2)))).otherwise(F.lit(""))
        return F.concat(*parts[:3], *more, tail, F.element_at(endings, (_number(digest, 42, len(ENDINGS[script][part])) + 1).cast("int")))

    made = F.when(kind == "email", email).when(kind == "secret", secret).when(kind == "ip", ip).when(
        kind.isin("phone", "ssn"), drawn).when(kind == "card", card).when(kind == "iban", _redrawn(entity, digest, 4))
    for script, parts in ENDINGS.items():
        for part in parts:
            made = made.when(kind == f"name:{script}:{part}", name(script, part))
    return made


def _dressed(part: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the form of the mention: its separators or its case."""
    spaced = F.array_join(F.transform(F.split(part, ""), lambda c, i: F.when(
        c.rlike("^[0-9A-Za-z]$"),
        F.substr(surrogate, F.length(F.regexp_replace(F.substr(part, F.lit(1), i + 1), r"[^0-9A-Za-z]", "")), F.lit(1)),
    ).otherwise(c)), "")
    shouted = (part == F.upper(part)) & (part != F.lower(part))
    return (
        F.when(kind.isin("phone", "card", "iban", "ssn"), spaced).when(shouted, F.upper(surrogate))
        .when(kind.startswith("name"), F.initcap(surrogate)).otherwise(surrogate)
    )


def surrogate_table(parts: DataFrame, key: str) -> DataFrame:
    """One surrogate for each (kind, entity) of ``parts``: kind, entity, surrogate; none is shared.

    Within a kind, of the candidates that meet, the first by entity stays and the others are drawn
    again, as is a candidate equal to an entity of the data. Rounds end when nothing is left to draw;
    each settles a share of what is left that doesn't depend on the size of the data.
    """
    entities = materialize(parts.select("kind", "entity").distinct(), "entities")
    todo, settled = entities.withColumn("attempt", F.lit(0)), []
    while True:
        made = todo.withColumn("surrogate", candidate(F.col("kind"), F.col("entity"), key, F.col("attempt")))
        made = made.withColumn("plain", normal(F.col("kind"), F.col("surrogate")))
        taken = reduce(DataFrame.unionByName, [
            entities.select("kind", F.col("entity").alias("plain")), *[s.select("kind", "plain") for s in settled]])
        taken = taken.distinct().withColumn("used", F.lit(True))
        firsts = made.groupBy("kind", "plain").agg(F.min("entity").alias("first"))
        drawn = materialize(made.join(taken, ["kind", "plain"], "left").join(firsts, ["kind", "plain"]), "drawn")
        good = F.col("used").isNull() & (F.col("entity") == F.col("first"))
        settled.append(drawn.where(good))
        todo = drawn.where(~good).select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, settled).select("kind", "entity", "surrogate")


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``n_replaced``; all other columns stay.

    Equal entities (but for case and the separators of numbers) get equal surrogates in every row, in
    the mention's own form. A name is replaced word by word after its form of address, so that a family
    name alone and behind a given name stay the same. Null and empty texts stay as they are; repeated
    rows come back each; columns named like those made here are kept apart by a prefix. The same key
    gives the same surrogates on the same data.

    A text is cut at its mentions and the pieces are joined with the surrogates, so replaced text is
    never read again. Distinct lists of mentions are looked up once; rows without a mention take no
    part in any join.
    """
    mine = "_pseudonym_mentions"
    found = F.when(F.col("text").rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    listed = docs.withColumn(mine, found)
    has = F.coalesce(F.size(mine) > 0, F.lit(False))
    lists = materialize(
        listed.where(has).select(F.xxhash64(mine).alias("list"), F.col(mine).alias("mentions")).distinct(), "mentions")

    whole = lists.select("list", "mentions", F.posexplode("mentions").alias("at", "mention")).withColumn(
        "sort", kind_of(F.col("mention")))
    called = F.col("sort") == "name"
    title = F.when(called, F.regexp_extract("mention", rf"^(?:{MALE}|{FEMALE})\.? ", 0)).otherwise(F.lit(""))
    words = F.when(called, F.split(F.substr("mention", F.length("title") + 1), " ")).otherwise(F.array("mention"))
    gender = F.when(F.col("title").rlike(rf"^(?:{MALE})\.? $"), "m").otherwise("f")
    script = F.when(F.col("part").rlike(r"\p{IsCyrillic}"), "cyrillic").when(
        F.col("part").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    parts = (
        whole.withColumn("title", title).withColumn("words", words)
        .select("list", "mentions", "at", "sort", "title", F.size("words").alias("n"), F.posexplode("words").alias("nth", "part"))
        .withColumn("kind", F.when(called, F.concat_ws(
            ":", F.lit("name"), script, F.when(F.col("nth") == F.col("n") - 1, "s").otherwise(gender))).otherwise(F.col("sort")))
        .withColumn("entity", normal(F.col("kind"), F.col("part")))
    )
    parts = materialize(parts, "parts")
    known = surrogate_table(parts, key)
    put = (
        parts.join(known, ["kind", "entity"])
        .withColumn("put", _dressed(F.col("part"), F.col("kind"), F.col("surrogate")))
        .groupBy("list", "mentions", "at", "title")
        .agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("nth", "put"))), lambda p: p["put"])).alias("put"))
        .groupBy("list", "mentions")
        .agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.concat("title", "put").alias("put")))),
                         lambda p: p["put"]).alias("_pseudonym_put"))
        .withColumnsRenamed({"list": "_pseudonym_list", "mentions": mine})
    )
    kept = [c for c in docs.columns if c != "n_replaced"]
    columns = [F.col(f"`{c}`") for c in kept if c != "text"]
    pieces = F.split("text", ANY)
    joined = F.array_join(F.zip_with(
        pieces, F.array_append("_pseudonym_put", F.lit("")), lambda piece, own: F.concat(piece, own)), "")
    changed = listed.where(has).withColumn("_pseudonym_list", F.xxhash64(mine)).join(
        put, ["_pseudonym_list", mine]).select(*columns, joined.alias("text"), F.size(mine).alias("n_replaced"))
    same = listed.where(~has).select(*columns, "text", F.lit(0).alias("n_replaced"))
    return changed.unionByName(same).select(*[F.col(f"`{c}`") for c in kept], "n_replaced")


@query("op2_surrogates")
def op2(spark, sf):
    """All documents with surrogates for the personal data in their texts."""
    return pseudonymize(table(spark, sf, "documents").select("doc_id", "text"), "surrogates of the corpus")

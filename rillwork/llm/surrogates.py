"""Personal data replaced by surrogates: keyed, of the same type and format, distinct and coreferent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillwork.llm.common import fresh, own, stow

#: What is found, in the order in which kinds are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ipv6": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"
    r"|(?=[A-Fa-f:]*+[0-9])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+?[0-9]{1,3}[ -]?)?\([0-9]{2,4}\)[ -]?[0-9]{3,4}[- ][0-9]{3,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}(?![0-9A-Za-z])"
    r"|(?<![0-9A-Za-z.-])[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z-])"
    r"|(?<![0-9A-Za-z+])\+[1-9][0-9]{7,14}(?![0-9A-Za-z])",
    "dialled": r"(?<=(?:[Tt]el|[Tt]elefon|[Pp]hone|[Mm]obile|[Cc]ell|[Cc]all|[Ff]ax)[.:]{0,2} {0,1})(?:[0-9]{7,12}|[0-9]{3}[-. ][0-9]{4})(?![0-9A-Za-z-])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "name": r"(?<!\p{L})(?:Mrs?|Ms|Miss|Herr|Frau|Señora?|Sra?|Monsieur|Madame|Mme|Dra?|Prof|Professora?|Доктор|Профессор|Господин|Госпожа)\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Cheap necessary condition: an at sign, two colons or a row of groups, four digits with at most a separator between, or a title.
_HINT = r"@|::|(?:[0-9A-Fa-f]{1,4}:){7}|(?:[0-9][ ().-]{0,2}){4}|(?:Mr|Ms|Miss|Herr|Frau|Se.or|Sr|Monsieur|Madame|Mme|Dr|Prof|Доктор|Профессор|Господин|Госпожа)"

#: Titles of women; after a title of either, a first name that ends in an a is a woman's.
_WOMEN = r"^(?:Mrs|Ms|Miss|Frau|Señora|Sra|Madame|Mme|Dra|Professora|Госпожа)\b|^(?:Dr|Prof|Professor|Доктор|Профессор)\.? \p{L}+[aа] \p{Lu}"
_FIRST = {
    ("latin", "f"): "Ada Bella Carla Dora Elena Flora Greta Hanna Irene Julia Klara Lena Maria Nora Olga Paula".split(),
    ("latin", "m"): "Adam Bruno Carlos David Emil Felix Georg Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Зоя Ирина Мария Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Марк Павел".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no pa pe ra re ro sa se ta te va ve".split(),
    "cyrillic": "ба бе бо да де до ва ве га го ка ке ла ле ло ма ме мо на не но па пе ра ре ро са се та те зо за".split(),
}
#: Draws that keep the format exactly; later ones add characters, so that every space is large enough.
STRICT = 6


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256)


def _digit(h: Column, at: Column) -> Column:
    return F.substring(F.translate(h, "abcdef", "012345"), at, F.lit(1))


def _letter(h: Column, at: Column) -> Column:
    return F.substring(F.translate(h, "0123456789abcdef", "ghijklmnopqrstuv"), at, F.lit(1))


def _like(text: Column, h: Column) -> Column:
    """Digits for digits and letters for letters, in their case; all else stays."""
    at = lambda i: (i % 64 + 1).cast("int")
    each = lambda c, i: (
        F.when(c.rlike("[0-9]"), _digit(h, at(i))).when(c.rlike("[a-z]"), _letter(h, at(i))).when(c.rlike("[A-Z]"), F.upper(_letter(h, at(i)))).otherwise(c)
    )
    return F.array_join(F.transform(F.split(text, ""), each), "")


def _byte(h: Column, i: int) -> Column:
    return F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int")


def _ip(text: Column, h: Column, wide: Column) -> Column:
    parts = F.split(text, "\\.")
    out = []
    for i in range(4):
        n, b = F.length(F.get(parts, F.lit(i))), _byte(h, i)
        out.append(F.when(wide, b).when(n == 1, b % 10).when(n == 2, 10 + b % 90).otherwise(100 + b % 156).cast("string"))
    return F.concat_ws(".", *out)


def _ipv6(text: Column, h: Column, wide: Column) -> Column:
    """Hex for hex in the same groups; a whole address where that space is used up."""
    hexed = lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(h, i % 64 + 1, F.lit(1))).when(c.rlike("[A-F]"), F.upper(F.substring(h, i % 64 + 1, F.lit(1)))).otherwise(c)
    whole = F.concat_ws(":", *[F.substring(h, 4 * i + 1, 4) for i in range(8)])
    return F.when(wide, whole).otherwise(F.array_join(F.transform(F.split(text, ""), hexed), ""))


def _luhn(digits: Column) -> Column:
    """Sum of a card number's digits, every second from the right doubled, modulo ten."""
    back = F.split(F.reverse(digits), "")
    terms = F.transform(back, lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(terms, F.lit(0), lambda a, t: a + t) % 10


def _card(text: Column, h: Column) -> Column:
    """Same first digit and grouping; passes the check digit if the original does."""
    drawn = F.concat(F.substring(text, 1, 1), F.expr("substring(_like, 2)"))
    bare = lambda c: F.regexp_replace(c, "[^0-9]", "")
    zero = F.concat(F.expr("substring(_drawn, 1, length(_drawn) - 1)"), F.lit("0"))
    fixed = F.concat(F.expr("substring(_drawn, 1, length(_drawn) - 1)"), ((10 - _luhn(bare(zero))) % 10).cast("string"))
    return drawn, F.when(_luhn(bare(text)) == 0, fixed).otherwise(F.col("_drawn"))


def _pick(words: list[str], h: Column, i: int) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), _byte(h, i) % len(words) + 1)


def _name(text: Column, key: str, draw: Column) -> Column:
    """The title stays; a first name by gender and script, a family name of drawn syllables."""
    parts = F.split(text, " ")
    women = text.rlike(_WOMEN)
    out = None
    for script in ("cyrillic", "latin"):
        last = F.element_at(parts, -1)
        h = _hash(key, F.lit("family"), last, draw.cast("string"))
        family = F.initcap(F.concat(*[_pick(_SYLLABLES[script], h, i) for i in range(4)], F.when(draw >= STRICT, F.concat(*[_pick(_SYLLABLES[script], h, i) for i in range(4, 9)])).otherwise("")))
        g = _hash(key, F.lit("first"), F.get(parts, F.lit(1)), draw.cast("string"))
        first = F.when(women, _pick(_FIRST[script, "f"], g, 0)).otherwise(_pick(_FIRST[script, "m"], g, 0))
        made = F.when(F.size(parts) > 2, F.concat_ws(" ", F.get(parts, F.lit(0)), first, family)).otherwise(F.concat_ws(" ", F.get(parts, F.lit(0)), family))
        out = F.when(text.rlike("[\\u0400-\\u04FF]"), made) if out is None else out.otherwise(made)
    return out


def _drawn(entities: DataFrame, key: str) -> DataFrame:
    """``surrogate`` of each ``kind, entity`` at its ``draw``."""
    h = _hash(key, F.col("kind"), F.col("entity"), F.col("draw").cast("string"))
    rows = entities.withColumn("_h", h).withColumn("_like", _like(F.col("entity"), F.col("_h")))
    start, card = _card(F.col("entity"), F.col("_h"))
    rows = rows.withColumn("_drawn", start)
    wide = F.col("draw") >= STRICT
    more = F.when(wide, F.translate(F.substring("_h", 40, 12), "0123456789abcdef", "ghijklmnopqrstuv")).otherwise("")
    tld = F.regexp_extract("entity", r"(\.[A-Za-z]+)$", 1)
    email = F.concat(more, F.expr("substring(_like, 1, length(_like) - length(_tld))"), F.col("_tld"))
    digits = F.concat(F.col("_like"), F.when(wide, F.translate(F.substring("_h", 40, 6), "abcdef", "012345")).otherwise(""))
    made = (
        F.when(F.col("kind") == "email", email)
        .when(F.col("kind") == "ip", _ip(F.col("entity"), F.col("_h"), wide))
        .when(F.col("kind") == "ipv6", _ipv6(F.col("entity"), F.col("_h"), wide))
        .when(F.col("kind") == "card", card)
        .when(F.col("kind") == "iban", F.concat(F.substring("entity", 1, 2), F.expr("substring(_like, 3)"), F.when(wide, F.upper(F.substring("_h", 40, 4))).otherwise("")))
        .when(F.col("kind") == "name", _name(F.col("entity"), key, F.col("draw")))
        .when(F.col("kind") == "phone", F.concat(F.col("_code"), F.expr("substring(_like, length(_code) + 1)"), F.when(wide, F.expr("right(_like, 4)")).otherwise("")))
        .otherwise(digits)
    )
    rows = rows.withColumn("_code", F.regexp_extract("entity", r"^(\+[0-9]{1,3}(?![0-9]))", 1))
    return rows.withColumn("_tld", tld).withColumn("surrogate", made).select("kind", "entity", "draw", "surrogate")


def surrogates(entities: DataFrame, key: str, rounds: int = 24) -> DataFrame:
    """``kind, entity, surrogate`` for distinct ``kind, entity``: one surrogate each, no two alike, none an original.

    Where draws collide, the first entity keeps its surrogate and the others draw again; only a count of
    open entities reaches the driver.
    """
    done, open_ = None, stow(entities.select("kind", "entity").distinct().withColumn("draw", F.lit(0)), "entities")
    originals = open_.select(F.col("entity").alias("surrogate"))
    for _ in range(rounds):
        drawn = _drawn(open_, key).join(originals.withColumn("taken", F.lit(True)).distinct(), "surrogate", "left")
        if done is not None:
            drawn = drawn.join(done.select("surrogate", F.lit(True).alias("used")), "surrogate", "left")
        else:
            drawn = drawn.withColumn("used", F.lit(None).cast("boolean"))
        # the first of those that drew the same wins; its row is found by a grouping, which combines before the shuffle
        winners = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "entity")).alias("w"))
        judged = drawn.join(winners, "surrogate").withColumn("ok", F.isnull("taken") & F.isnull("used") & (F.col("w") == F.struct("kind", "entity")))
        judged = stow(judged.select("kind", "entity", "draw", "surrogate", "ok"), "draws")
        good = judged.where("ok").select("kind", "entity", "surrogate")
        done = good if done is None else done.union(good)
        open_ = judged.where("not ok").select("kind", "entity", (F.col("draw") + 1).alias("draw"))
        if open_.isEmpty():
            return done
    raise RuntimeError(f"some entities still collide after {rounds} draws")


def replace_private(docs: DataFrame, key: str = "rillwork") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by surrogates, plus ``n_replaced``.

    One entity has one surrogate in the whole corpus, so mentions still refer to each other, and no two
    entities share one. Digits stand for digits and letters for letters; card numbers that pass their
    check digit still do, octets stay octets and groups groups, a country code stays, a title keeps its gender
    and a name its script. Bare digits are a phone number after a word that says so. Overlaps go to the leftmost match. A null text stays null, an empty one empty, both with 0 replaced; rows without
    personal data pass through unchanged. Rows are told apart by a number of their own, so repeated rows
    and null ids keep theirs; other columns pass through, but for one named ``n_replaced``, which is replaced.
    """
    docs = docs.drop("n_replaced")
    names = own(docs)
    spans, gaps, row, drawn = fresh(docs, "_m", "_gaps", "_row", "_s")
    found = F.coalesce(F.col("text").rlike(_HINT), F.lit(False))
    matches = F.when(found, F.regexp_extract_all("text", F.lit(f"({ANY})"), F.lit(0)))
    listed = docs.withColumn(spans, matches)
    clean = listed.where(F.isnull(spans) | (F.size(spans) == 0)).withColumn("n_replaced", F.lit(0).cast("long"))
    hits = listed.where(F.size(spans) > 0).withColumn(row, F.monotonically_increasing_id())
    hits = stow(hits.select(*names, spans, row, F.split("text", f"(?:{ANY})", -1).alias(gaps)), "hits")
    kind = None
    for name, pattern in PATTERNS.items():
        test = F.col("entity").rlike(f"^(?:{pattern})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    spots = hits.select(F.col(row).alias("row"), F.posexplode(spans).alias("at", "entity"))
    named = spots.select("entity").distinct().withColumn("kind", kind.otherwise("digits"))
    made = surrogates(named, key)
    subs = spots.join(made.select("entity", "surrogate"), "entity").groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("at", "surrogate"))).alias(drawn))
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(drawn), i)["surrogate"], F.lit("")))), "")
    fixed = hits.join(subs, row).withColumn("text", text).withColumn("n_replaced", F.size(spans).cast("long"))
    return clean.select(*names, "n_replaced").unionByName(fixed.select(*names, "n_replaced"))

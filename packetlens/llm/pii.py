"""Personal data: spans found by patterns and judged by weak supervision; DataFrame code only.

Strict patterns give the base spans (e-mail, IP, card and phone), which always
stay.  Looser candidates (bracketed "at" addresses, local phone numbers of four
countries, shorter card numbers, names after titles or given names, street
addresses, told secrets) are judged: labelers (format, check, gazetteer,
context, shape) vote on every span, strict ones included; expectation
maximisation over the vote patterns of the whole corpus estimates how reliable
each labeler is, and the resulting soft labels train a naive Bayes span
classifier on the votes and further span features, which accepts candidates at
``accept``.  Context is read on both sides of a span.  The driver sees counts
per vote pattern and per feature value only.

Positions come from marking matches with private-use characters and measuring
the pieces.  Patterns contain no repeated groups (their inner separators are
replaced one by one first), so long runs neither recurse nor backtrack.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prefix_reduce

KINDS = ["email", "ip", "card", "phone", "name", "address", "secret"]
OPEN, CLOSE, INNER, OTHER, FILL = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004"

#: Gazetteers (fixed values).
ENDINGS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu"]
GIVEN = ("Adam Alan Alejandro Alexander Alice Amanda Amy Ana Andrea Andreas Andrew Angela Anna Anne Anthony Antoine Antonio Barbara Benjamin Brian "
         "Camille Carlos Carmen Carol Caroline Catherine Charles Charlotte Chloé Christian Christine Christopher Claire Claudia Daniel David Deborah "
         "Diego Dorothy Edward Elena Elizabeth Emily Emma Eric Ethan Eva Felix Fernando Florian François Frank Gabriel George Grace Hannah Hans Heather "
         "Heidi Helen Henry Isabel Isabelle Jack Jacob James Jan Janet Jason Javier Jean Jennifer Jessica Joan Johannes John Jonas Jordan Jorge José Joseph "
         "Joshua Juan Julia Julien Jürgen Karen Karl Katharina Kevin Klaus Larissa Laura Lars Léa Lena Leon Linda Lisa Louis Lucas Lucía Luis Luke Manuel "
         "Marc Marco Margaret Maria María Marie Mark Markus Marta Martin Mary Mathieu Matthew Matthias Maximilian Megan Michael Michelle Miguel Monika "
         "Nancy Nathalie Nicholas Nicolas Nicole Nina Nora Oliver Olivia Pablo Pamela Patricia Patrick Paul Pedro Peter Philip Pierre Rachel Raúl Rebecca "
         "Richard Robert Rosa Ryan Samuel Sandra Sara Sarah Scott Sebastian Sofía Sophie Stefan Stephen Steven Susan Sylvie Teresa Thomas Timothy Tobias "
         "Ursula Victor Victoria Walter William Wolfgang").split()
SURNAMES = ("Anderson Baker Becker Bernard Brown Carter Clark Collins Davis Díaz Dubois Dupont Durand Evans Fernández Fischer García Garcia González Green "
            "Hall Harris Hernández Hoffmann Hill Jackson Johnson Jones Keller King Klein Koch Laurent Lee Lefebvre Leroy Lewis López Martin Martínez Meyer "
            "Miller Mitchell Moore Moreau Morris Müller Muñoz Nelson Neumann Parker Pérez Petit Phillips Ramírez Richter Roberts Robinson Rodríguez "
            "Rodriguez Roux Ruiz Sánchez Schmidt Schneider Schröder Schulz Schwarz Scott Simon Smith Taylor Thomas Thompson Torres Turner Vázquez Wagner "
            "Walker Weber White Williams Wilson Wolf Wright Young Zimmermann").split()
CITIES = ("Amsterdam Atlanta Austin Barcelona Berlin Bilbao Birmingham Bordeaux Boston Bremen Bristol Chicago Dallas Denver Dresden Dublin Düsseldorf "
          "Edinburgh Frankfurt Glasgow Hamburg Hannover Houston Köln Leeds Leipzig Lille Liverpool London Lyon Madrid Málaga Manchester Marseille Miami "
          "München Nantes Nice Nürnberg Oxford Paris Philadelphia Phoenix Portland Seattle Sevilla Springfield Strasbourg Stuttgart Toulouse Valencia "
          "Vienna Wien Zaragoza Zürich").split()
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sra"
STREETS = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Way|Place|Terrace"
HINTS = {
    "email": "mail|contact|write|e-mail|address|kontakt|correo|courriel",
    "ip": "ip|host|server|address|addr|ping",
    "card": "card|visa|mastercard|amex|credit|pay|karte|tarjeta|carte",
    "phone": "tel|telefon|teléfono|téléphone|phone|call|calls|fax|mobile|cell|dial|whatsapp|ruf|rufen|llame|llamar|appelez|number|nummer|número|numéro",
    "name": "name|names|named|dear|by|from|contact|signed|sign|author|heiße|heißt|von|nombre|llamo|nom|appelle|with|ask|regards|hello|hi|patient|client",
    "address": "address|live|lives|living|at|located|ship|deliver|send|home|wohnt|wohne|adresse|anschrift|dirección|vive|vivo|habite|domicilio|to",
    "secret": "my|your|new|temporary|login|account|credentials|root|admin|user|mein|dein|mi|mon|username|the",
}
#: What speaks against a kind right before a span, and right after it.
AGAINST = "version|v|isbn|order|invoice|id|no|nr|page|section|line"
AFTER_AGAINST = {
    "name": r"^(['’]s (law|theorem|method)|[ -](street|st|avenue|road|airport|university|hotel|hospital|school|bridge|theorem|award|prize|foundation)\b)",
    "address": r"^ (project|method|journal|times|capital|partners)\b",
    "secret": r"^ (policy|policies|field|fields|length|manager|reset|required|must|should|is|was)\b",
    "phone": r"^ ?(pages|units|pieces|items|kg|km|eur|usd|%)",
}
#: Area codes of larger cities and services (first digits of national numbers; fixed values).
AREAS = ("030|040|069|089|0211|0221|0228|0231|0341|0351|0421|0511|0621|0711|0911|015[0-9]|016[0-9]|017[0-9]|01|02|03|04|05|06|07|09|91|93|94|95|96|"
         "6[0-9]{2}|7[1-9][0-9]|212|213|305|312|404|415|512|617|646|702|713|718|773|818|917")
LABELERS = ["format", "check", "gazetteer", "context", "shape"]


@dataclass(frozen=True)
class PiiParams:
    accept: float = 0.9
    rounds: int = 50
    around: int = 40  # characters before and after a span in which context counts


NO_SPANS = "array<struct<s:bigint,m:string,before:string,after:string>>"


def _with_spans(rows: DataFrame, name: str, src: Column, pattern: str, keep: int) -> DataFrame:
    """``rows`` with ``name``: array<struct<s, m, before, after>> of the leftmost non-overlapping matches of ``pattern``.

    A null ``src`` has none.  Pieces and their positions are columns of their
    own, so that they are computed once a row and not once a match.
    """
    rows = rows.withColumn("__p", F.split(F.regexp_replace(src, f"({pattern})", f"{OPEN}$1{CLOSE}"), OPEN, -1))
    rows = rows.withColumn("__l", F.transform("__p", lambda x, i: F.length(x) - F.when(i > 0, F.lit(1)).otherwise(F.lit(0))))
    rows = rows.withColumn("__a", prefix_reduce(F.col("__l"), F.lit(0), lambda a, b: a + b))
    found = F.transform(
        F.sequence(F.lit(1), F.size("__a") - 2),
        lambda i: F.struct(F.get("__a", i).cast("long").alias("s"),
                           F.substring_index(F.get("__p", i), CLOSE, 1).alias("m"),
                           F.translate(F.right(F.get("__p", i - 1), F.lit(keep)), CLOSE, " ").alias("before"),
                           F.left(F.substring_index(F.get("__p", i), CLOSE, -1), F.lit(keep)).alias("after")))
    return rows.withColumn(name, F.when(F.size("__p") > 1, found).otherwise(F.array().cast(NO_SPANS))).drop("__p", "__l", "__a")


def _fill(src: str, spans: str) -> Column:
    """The text column ``src`` with the spans overwritten by as many fill characters."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["s"] + F.length(x["m"])))
    parts = F.transform(starts, lambda p, i: F.concat(
        F.substring(src, (p + 1).cast("int"), (F.coalesce(F.get(spans, i)["s"], F.length(src).cast("long")) - p).cast("int")),
        F.coalesce(F.repeat(F.lit(FILL), F.length(F.get(spans, i)["m"])), F.lit(""))))
    return F.when(F.size(spans) == 0, F.col(src)).otherwise(F.concat_ws("", parts))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    """Luhn check of a digit string."""
    ds = F.reverse(F.transform(F.split(m, ""), lambda d: d))
    values = F.transform(F.filter(ds, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10 == 0


def _octets_fit(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+(?=.)", ""))
    return F.forall(parts, lambda x: (F.length(x) <= 3) & (F.left(x, F.lit(3)).cast("int") <= 255))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit("+")).when(no, F.lit("-")).otherwise(F.lit("0"))


def _word_in(words: list[str], of: Column) -> Column:
    return of.isin(*words)


def _signs(kind: str, x: Column, m: Column, ds: Column, n: Column, words: Column, bad: Column) -> tuple[Column, Column, Column]:
    """Votes of format, check and gazetteer on a span of a kind; a format that also fits other things is none next to what speaks against it."""
    after = x["after"]
    if kind == "email":
        last = F.regexp_extract(m, r"([A-Za-z0-9-]+)\W*$", 1)
        check, gaz = F.length(last) >= 2, F.lower(last).isin(*ENDINGS)
        return _vote(m.contains("@"), ~m.contains("@")), _vote(check, ~check), _vote(gaz, ~gaz)
    if kind == "ip":
        check = _octets_fit(m)
        gaz = F.regexp_replace(F.substring_index(m, ".", 1), "^0+(?=.)", "").rlike("^([1-9][0-9]?|1[0-9][0-9]|2[01][0-9]|22[0-3])$")
        return _vote(check, ~check), _vote(check, ~check), _vote(gaz, ~gaz)
    if kind == "card":
        check, gaz, long = _luhn(ds), ds.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65)"), n.between(16, 19)
        return _vote(check & long, ~(check & long)), _vote(check, ~check), _vote(gaz, ~gaz)
    if kind == "phone":
        sure, check, gaz = m.startswith("+"), n.between(8, 15), m.rlike(rf"^(\+|\(?({AREAS})(?![0-9]))")
        return _vote(sure, bad), _vote(check, ~check), _vote(gaz, F.lit(False))
    if kind == "name":
        last = F.regexp_extract(m, r"([^ ]+)$", 1)
        given = F.regexp_replace(m, rf"^({TITLES})\.? ", "")
        given = F.substring_index(given, " ", 1)
        titled = m.rlike(rf"^({TITLES})\.? ")
        # an article, a number or a capitalised word next to it: part of a longer name of something else
        part = x["before"].rlike("(?:(?<![A-Za-z])[Tt]he|[0-9]|[A-ZÀ-Ý][a-zß-ÿ]+) $") | after.rlike("^ [A-ZÀ-Ý][a-zß-ÿ]")
        return _vote(titled, bad | part), _vote(_word_in(SURNAMES, last) & ~part, part), _vote(_word_in(GIVEN, given), ~titled)
    if kind == "address":
        zipped = after.rlike(r"^,? ?[0-9A-Za-z .,#-]{0,30}?\b([0-9]{5}|[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}|[A-Z]{2} [0-9]{5})\b")
        city = after.rlike(r"^[ ,.0-9A-Za-z-]{0,25}\b(" + "|".join(CITIES) + r")\b")
        numbered = m.rlike("^[0-9]|[0-9][a-z]?$")
        return _vote(numbered & ~bad, ~numbered | bad), _vote(zipped, F.lit(False)), _vote(city, F.lit(False))
    mixed = m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    plain = m.rlike("^[a-zà-ÿ]+[.,;:!?]?$")
    marked = words.rlike("[:=] ?[\"']?$")
    return _vote(mixed | m.rlike("[^A-Za-z0-9]."), plain), _vote(F.length(m) >= 8, F.length(m) < 5), _vote(marked, plain & ~marked)


def _judged(spans: Column, kind: str, base) -> Column:
    """The spans of a kind with base flag, vote string and feature values."""
    against = AFTER_AGAINST.get(kind)

    def one(x: Column) -> Column:
        m, ds = x["m"], _digits(x["m"])
        n = F.length(ds)
        words, after = F.lower(x["before"]), F.lower(x["after"])
        bad = words.rlike(rf"(?<![a-z])({AGAINST})[ .:#]*$") if kind not in ("name", "secret") else F.lit(False)
        if against:
            bad = bad | after.rlike(against)
        good = words.rlike(f"(?<![a-zà-ÿ])({HINTS[kind]})(?![a-zà-ÿ])")
        context = F.when(bad, F.lit("-")).when(good, F.lit("+")).otherwise(F.lit("0"))
        bounds = words.rlike(r"(^|[\s(\[<\"':;,=])$") & (after.rlike(r"^[\s)\].,;:!?>\"']") | (after == ""))
        votes = F.concat(*_signs(kind, x, m, ds, n, words, bad), context, _vote(bounds, F.lit(True)))
        share = F.floor(n * 4 / F.length(m)).cast("int")
        code = lambda v: F.instr(F.lit("+-0"), v)
        feats = F.array(F.least(F.floor(F.length(m) / 4), F.lit(12)).cast("int"), share,
                        F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(8)),
                        F.when(after == "", 0).when(after.rlike(r"^\s"), 1).when(after.rlike("^[a-z0-9]"), 2).otherwise(3),
                        *[code(F.substring(votes, k + 1, 1)) for k in range(len(LABELERS))])
        return F.struct(F.lit(KINDS.index(kind)).alias("kind"), x["s"].alias("s"), (x["s"] + F.length(m)).alias("e"),
                        base(x).alias("base"), votes.alias("votes"), feats.alias("feats"))
    return F.transform(spans, one)


def candidates(docs: DataFrame, p: PiiParams = PiiParams(), text: str = "text") -> DataFrame:
    """doc_id and ``spans``: all base spans and candidates of each whole text, with votes and features."""
    clean = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), OPEN + CLOSE + INNER + FILL, OTHER * 4)
    found = docs.select("doc_id", clean.alias("t"))
    digit, at, plus = F.col("t").rlike("[0-9]"), F.col("t").contains("@"), F.col("t").contains("+")
    # separators inside addresses and numbers become a mark, so that the patterns need no repeated groups
    dotted = F.when(at, F.regexp_replace("t", r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", INNER))
    grouped = F.when(digit, F.regexp_replace("t", r"(?<=[0-9])[ -](?=[0-9])", INNER))
    local = f"A-Za-z0-9._%+{INNER}-"
    none = F.lit(False)
    digits = lambda x: F.length(_digits(x["m"]))
    found = _with_spans(found, "email", dotted, rf"(?:\G|(?<![{local}]))[{local}]+@[A-Za-z0-9-]+{INNER}[A-Za-z0-9{INNER}-]+", p.around)
    found = _with_spans(found, "ip", F.when(digit, F.col("t")), r"(?:\G|(?<![0-9]))[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", p.around)
    found = _with_spans(found, "card", grouped, f"[0-9][0-9{INNER}]+", p.around)
    found = _with_spans(found, "phone", F.when(plus, F.col("t")), r"\+[0-9][ ().0-9-]+[0-9]", p.around)
    sides = lambda x, to: x.withField("before", F.translate(x["before"], INNER, to)).withField("after", F.translate(x["after"], INNER, to))
    dots = lambda a: F.transform(a, lambda x: sides(x.withField("m", F.translate(x["m"], INNER, ".")), "."))
    seps = lambda a: F.transform(a, lambda x: sides(x, " "))
    phone_ok = lambda x: x["m"].startswith("+") & digits(x).between(8, 15)
    email_ok = lambda x: x["m"].contains("@")
    found = found.select(
        "doc_id", "t", dots("email").alias("email"), "ip", seps(F.filter("card", lambda x: digits(x).between(13, 19))).alias("card"),
        "phone", F.filter("phone", phone_ok).alias("sure"))
    loose_mail = r"[A-Za-zÀ-ÿ0-9._%+-]{1,64}[ ]?[\[(]at[\])][ ]?[A-Za-z0-9-]{1,63}(?:\.|[ ]?[\[(]dot[\])][ ]?)[A-Za-z0-9.-]{0,253}[A-Za-z0-9]"
    bracketed = F.col("t").contains("(at)") | F.col("t").contains("[at]")
    # national forms: three groups of the US, German area codes, five French pairs, three Spanish groups
    loose_phone = (r"(?<![0-9+.,/-])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|\(?0[1-9][0-9]{1,3}\)?[ /-]{1,3}[0-9]{4,8}|\(?0[1-9][0-9]{1,3}\)?[ /-][0-9]{2,4} [0-9]{2,5}"
                   r"|0[1-9][ .][0-9]{2}[ .][0-9]{2}[ .][0-9]{2}[ .][0-9]{2}|[6789][0-9]{2} [0-9]{3} [0-9]{3})(?![0-9.-]*[0-9])")
    found = _with_spans(found, "email2", F.when(bracketed, F.col("t")), loose_mail, p.around)
    found = found.withColumn("masked", F.when(F.col("t").rlike(loose_phone), _fill("t", "sure")))
    found = _with_spans(found, "phone2", F.col("masked"), loose_phone, p.around)
    word = "[A-ZÀ-Ý][a-zß-ÿ'’-]{1,30}"
    titled = rf"(?:{TITLES})\.? {word}(?: {word})?"
    given = "(?:" + "|".join(GIVEN) + rf") (?:[A-Z]\. )?{word}"
    named = r"(?<![A-Za-zÀ-ÿ0-9@.-])(?=[A-Z])(?:" + titled + "|" + given + r")(?![A-Za-zÀ-ÿ@])"
    found = _with_spans(found, "name", F.when(F.col("t").rlike(r"(?<![A-Za-zÀ-ÿ])(?:" + "|".join([*GIVEN, TITLES]) + r")\.? [A-ZÀ-Ý]"), F.col("t")), named, p.around)
    street = (rf"[0-9]{{1,5}}[A-Za-z]? (?:{word} ){{1,3}}(?:{STREETS})(?![A-Za-z])"
              r"|[A-ZÄÖÜ][a-zäöüß-]{1,30}(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?(?![0-9A-Za-z])"
              rf"|[0-9]{{1,4}}(?: bis| ter)?,? (?:rue|avenue|boulevard|chemin|impasse|quai) (?:de la |de l'|du |des |de |d')?{word}"
              rf"|(?:Calle|Avenida|Plaza|Paseo|Carrer) (?:de la |de los |del |de )?{word},? (?:n[.º°] ?)?[0-9]{{1,4}}(?![0-9])")
    some_street = rf" (?:{STREETS})(?![A-Za-z])|(?:straße|strasse|str\.|weg|platz|allee|gasse) [0-9]|[0-9],? (?:bis |ter )?(?:rue|avenue|boulevard|chemin|impasse|quai) |(?:Calle|Avenida|Plaza|Paseo|Carrer) "
    found = _with_spans(found, "address", F.when(digit & F.col("t").rlike(some_street), F.col("t")), r"(?<![A-Za-z0-9])(?:" + street + ")", p.around)
    told = r"(?i:password|passwd|passphrase|passwort|kennwort|contraseña|mot de passe|pin code|secret key|api key)"
    # the words that tell a secret, then the secret: a match is cut down to its last part
    telling = told + r"(?i: ist| is| lautet| est| es)?[ ]?[:=]?[ ]?[\"'“]?"
    found = _with_spans(found, "told", F.when(F.col("t").rlike(told), F.col("t")), telling + rf"[^ \t\r\n\"'”<>{OPEN}{CLOSE}]{{4,64}}", p.around)

    def value(x: Column) -> Column:
        lead = F.regexp_extract(x["m"], f"^({telling})", 1)
        own = F.regexp_replace(F.substring(x["m"], F.length(lead) + 1, F.length(x["m"])), r"[.,;:!?)]+$", "")
        return F.struct((x["s"] + F.length(lead)).alias("s"), own.alias("m"), F.concat(x["before"], lead).alias("before"), x["after"].alias("after"))

    found = found.withColumn("secret", F.filter(F.transform("told", value), lambda x: F.length(x["m"]) >= 4))
    strict_card = lambda x: digits(x).between(16, 19) & _luhn(_digits(x["m"]))
    never = lambda x: none & x["m"].isNotNull()
    return found.select("doc_id", F.concat(
        _judged(F.col("email"), "email", email_ok), _judged(F.col("email2"), "email", never),
        _judged(F.col("ip"), "ip", lambda x: _octets_fit(x["m"])), _judged(F.col("card"), "card", strict_card),
        _judged(F.filter("phone", lambda x: digits(x).between(8, 15)), "phone", phone_ok), _judged(F.col("phone2"), "phone", never),
        _judged(F.col("name"), "name", never), _judged(F.col("address"), "address", never), _judged(F.col("secret"), "secret", never)).alias("spans"))


def estimate(patterns: list[tuple[int, str, int]], rounds: int) -> dict[tuple[int, str], float]:
    """Chance of being personal data for each (kind, vote pattern), by expectation maximisation over their counts.

    One coin per kind, one reliability per labeler and class; starts with every
    labeler right in 8 of 10 votes.  ``patterns`` has (kind, votes, count) rows.
    """
    out = {}
    for kind in sorted({k for k, _, _ in patterns}):
        mine = [(v, c) for k, v, c in patterns if k == kind]
        prior = 0.5
        agree = [(0.8, 0.2)] * len(LABELERS)  # chance of a yes among votes, for true and for false spans
        for _ in range(rounds):
            post = {}
            for v, _ in mine:
                t, f = math.log(prior), math.log(1 - prior)
                for x, (yes_t, yes_f) in zip(v, agree):
                    if x != "0":
                        t += math.log(yes_t if x == "+" else 1 - yes_t)
                        f += math.log(yes_f if x == "+" else 1 - yes_f)
                post[v] = 1 / (1 + math.exp(min(700, max(-700, f - t))))
            total = sum(c for _, c in mine)
            prior = min(0.999, max(0.001, (sum(post[v] * c for v, c in mine) + 1) / (total + 2)))
            agree = []
            for j in range(len(LABELERS)):
                rate = []
                for side in (lambda q: q, lambda q: 1 - q):
                    yes = sum(side(post[v]) * c for v, c in mine if v[j] == "+")
                    no = sum(side(post[v]) * c for v, c in mine if v[j] == "-")
                    start = 0.8 if not rate else 0.2
                    rate.append(min(0.999, max(0.001, (yes + 2 * start) / (yes + no + 2))))
                agree.append(tuple(rate))
        out.update({(kind, v): post[v] for v, _ in mine})
    return out


def _literal_map(values: dict[str, float]) -> Column:
    if not values:
        return F.create_map(F.lit(""), F.lit(0.0))
    return F.create_map(*[x for k, v in sorted(values.items()) for x in (F.lit(k), F.lit(float(v)))])


def find(docs: DataFrame, p: PiiParams = PiiParams(), text: str = "text") -> DataFrame:
    """doc_id and ``spans`` (array of kind number, start, end exclusive in code points, base) of every row of ``docs``.

    Base spans stay whatever the classifier says; candidates join them at a
    chance of ``accept``.  Null and empty texts have no spans, repeated rows get
    the same spans each, other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    rows = scratch.keep(candidates(docs, p, text), "candidates")
    each = rows.select(F.explode("spans").alias("x")).select("x.*")
    counts = each.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()
    post = estimate([(r["kind"], r["votes"], r["n"]) for r in counts], p.rounds)
    soft = _literal_map({f"{k}{v}": q for (k, v), q in post.items()})
    # naive Bayes on span features, trained on the soft labels of all spans
    seen = (each.select("kind", F.element_at(soft, F.concat(F.col("kind").cast("string"), "votes")).alias("q"), F.posexplode("feats").alias("f", "value"))
            .groupBy("kind", "f", "value").agg(F.sum("q").alias("yes"), F.sum(1 - F.col("q")).alias("no")).collect())
    odds: dict[str, float] = {}
    for kind in {r["kind"] for r in seen}:
        for f in {r["f"] for r in seen}:
            mine = [r for r in seen if r["kind"] == kind and r["f"] == f]
            yes, no = sum(r["yes"] for r in mine), sum(r["no"] for r in mine)
            odds[f"{kind}:"] = math.log((yes + 1) / (no + 1))
            odds.update({f"{kind}:{f}:{r['value']}": math.log((r["yes"] + 1) / (yes + len(mine)) / ((r["no"] + 1) / (no + len(mine)))) for r in mine})
    table = _literal_map(odds)

    def chance(x: Column) -> Column:
        kind = x["kind"].cast("string")
        total = F.aggregate(F.transform(x["feats"], lambda v, i: F.coalesce(F.element_at(table, F.concat(kind, F.lit(":"), i.cast("string"), F.lit(":"), v.cast("string"))), F.lit(0.0))),
                            F.lit(0.0), lambda a, b: a + b)
        return 1 / (1 + F.exp(-F.least(F.lit(500.0), F.greatest(F.lit(-500.0), total + F.coalesce(F.element_at(table, F.concat(kind, F.lit(":"))), F.lit(0.0))))))

    kept = F.filter("spans", lambda x: x["base"] | (chance(x) >= p.accept))
    return rows.select("doc_id", F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["base"].alias("base")))).alias("spans"))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind then start."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))))


def span_rows(docs: DataFrame, p: PiiParams = PiiParams(), text: str = "text") -> DataFrame:
    """doc_id and every span's kind, start, end and base flag as rows."""
    return find(docs, p, text).select("doc_id", F.explode("spans").alias("x")).select("doc_id", F.get(F.array(*[F.lit(k) for k in KINDS]), F.col("x.kind")).alias("kind"), "x.s", "x.e", "x.base")

"""Questions read into verified facts: services, cities, vehicle, amounts, verdicts and prices, as expressions.

``detect`` gives one ``array<struct<service, text>>`` per question, in the order
of the rules. All tables are literals of fixed size, so a plan with these
expressions has no join and no shuffle.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstone.functions import fixed
from loomstone.functions.fixed import SENTENCES as S
from loomstone.functions.fixed import Domain
from loomstone.functions.text import fill, group, has, let, lookup, says, seen, unsupported_figures, word_count

HISTORY = "array<struct<role:string,content:string>>"
DEFAULT = Domain()


def one_of(choices: list[tuple[Column, Column]], otherwise: Column | None = None) -> Column:
    """The value of the first condition that holds."""
    out = reduce(lambda acc, c: acc.when(*c), choices[1:], F.when(*choices[0]))
    return out if otherwise is None else out.otherwise(otherwise)


def name_list(names: tuple[str, ...]) -> str:
    return f"{', '.join(names[:-1])} and {names[-1]}"


def join_names(names: Column) -> Column:
    """"A, B and C" of an array of names."""
    n = F.size(names)
    return F.when(n > 1, F.concat(F.array_join(F.slice(names, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(names, -1))).otherwise(F.array_join(names, ""))


# --- Reading -------------------------------------------------------------------------


def services(text: Column, domain: Domain = DEFAULT) -> Column:
    """Names of all services whose pattern the text matches, in the rules' order. An open-letter phrase doesn't count."""
    bare = F.regexp_replace(text, "(?iU)" + fixed.OPEN_LETTER, " ")
    hits = lambda t: F.array(*(F.when(says(t, p.replace("{brand}", re.escape(domain.brand))), F.lit(name)) for name, p in fixed.SERVICES))
    return F.array_compact(let(seen(bare), hits))


def previous_services(history: Column, domain: Domain = DEFAULT) -> Column:
    """Services of the newest user message that names any; empty where none does."""
    asked = F.filter(history, lambda m: (m["role"] == "user") & m["content"].isNotNull())
    named = F.filter(F.transform(asked, lambda m: services(m["content"], domain)), lambda s: F.size(s) > 0)
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.array().cast("array<string>"))


_CANON = {c.lower(): c for c in (*fixed.INSPECTION_CITIES, *fixed.SALE_CITIES, *fixed.TRANSFER_CITIES, *fixed.OTHER_CITIES)}
_CITY_NAMES = sorted({*_CANON.values(), *fixed.CITY_ALIASES}, key=lambda c: (-len(c), c))
CITY = r"(?<![\w.])(" + "|".join(re.sub(r"([.])", r"\\\1", c) for c in _CITY_NAMES) + r")(?!\w)"


def cities(text: Column) -> Column:
    """Cities named, by their usual name, each once, in order of the text; longer names are found first."""
    found = F.regexp_extract_all(text, F.lit("(?iU)" + CITY), F.lit(1))
    usual = F.transform(found, lambda c: F.coalesce(lookup(F.lower(c), fixed.CITY_ALIASES), lookup(F.lower(c), _CANON)))
    return F.array_distinct(F.filter(usual, lambda c: c.isNotNull()))


def first_match(text: Column, rules: list[tuple[str, Column]]) -> Column:
    """The value of the first rule, in order, whose pattern the text matches."""
    return let(seen(text), lambda t: one_of([(says(t, pattern), value) for pattern, value in rules]))


def german_name(brand: Column, model: Column) -> Column:
    """Brand and model as answers show them: E-Class, 3 Series, A4."""
    low = F.lower(model)
    shown = (
        F.when(low.endswith("-class"), F.concat(F.upper(F.split(low, "-")[0]), F.lit("-Class")))
        .when(low.endswith("series"), F.concat(F.upper(F.split(low, r"\s+")[0]), F.lit(" Series")))
        .otherwise(F.concat(F.upper(F.substring(model, 1, 1)), F.expr("''"), F.substring(model, F.lit(2), F.char_length(model))))
    )
    usual = lookup(F.lower(brand), fixed.GERMAN_BRANDS)
    return F.when(model.isNull(), usual).otherwise(F.concat_ws(" ", usual, shown))


def _vehicle(kind: str, name: Column, cc: Column, band: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), name.cast("string").alias("name"), cc.cast("int").alias("cc"), band.cast("string").alias("band"))


def band_of(cc: Column) -> Column:
    return one_of([(cc <= most, F.lit(band)) for most, band in fixed.BAND_LIMITS], F.lit("large"))


def vehicle(text: Column) -> Column:
    """struct<kind, name, cc, band> of the car, engine size or body type named, else null.

    German brands come first, then car models in the rules' order. Where the
    body decides the band the car stands; else an engine size overrides it, and
    a body word is the last resort.
    """
    none = F.lit(None)
    brand = group(text, fixed.GERMAN, 1)
    german = _vehicle("car", german_name(brand, group(text, fixed.GERMAN, 2)), none, F.lit("german"))
    listed = first_match(text, [(p, _vehicle("car", F.lit(name), none, F.lit(band))) for p, name, band in fixed.CARS])
    litres = F.bround(group(text, fixed.ENGINE_LITRES).cast("double") * 1000).cast("int")
    written = group(text, fixed.ENGINE_CC)
    size = F.when(written.isNotNull(), written.cast("int")).otherwise(litres)
    body = F.lower(group(text, r"\b(suv|4x4|jeep|german car)\b"))
    by_body = _vehicle("body", lookup(body, {k: v[0] for k, v in fixed.BODY.items()}), none, lookup(body, {k: v[1] for k, v in fixed.BODY.items()}))

    def settle(v: Column) -> Column:
        car = v["car"]
        return (
            F.when(car["band"].isin(*fixed.BODY_BANDS), car)
            .when(F.coalesce(v["cc"], F.lit(0)) != 0, _vehicle("cc", none, v["cc"], band_of(v["cc"])))
            .when(car.isNotNull(), car)
            .when(v["body"]["name"].isNotNull(), v["body"])
        )

    return let(F.struct(F.when(brand.isNotNull(), german).otherwise(listed).alias("car"), size.alias("cc"), by_body.alias("body")), settle)


def amount_in_lakh(text: Column) -> Column:
    """A sale price in units of 100,000: crore, else lakh, else rupees of at least one lakh."""
    rupees = F.regexp_replace(group(text, fixed.RUPEES), ",", "").try_cast("bigint")
    return F.coalesce(group(text, fixed.CRORE).try_cast("double") * 100, group(text, fixed.LAKH).try_cast("double"), F.when(rupees >= 100_000, rupees / F.lit(100_000)))


# --- Sentences ---------------------------------------------------------------------------


def money(n: Column) -> Column:
    return F.concat(F.lit("PKR "), F.format_number(n, 0))


def short_number(x: Column) -> Column:
    """Up to six significant digits without trailing zeros (values below a million)."""
    digits = F.lit(5) - F.floor(F.log10(F.greatest(x, F.lit(1e-4))))
    scaled = F.bround(x * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.regexp_replace(F.regexp_replace(scaled.cast("decimal(30,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def lakh_label(lakh: Column) -> Column:
    return F.when(lakh >= 100, F.concat(short_number(lakh / 100), F.lit(" crore"))).otherwise(F.concat(short_number(lakh), F.lit(" lakh")))


def commission(lakh: Column) -> Column:
    """struct<price, commission, one_percent> in rupees: one percent, whole, at least the minimum up to 5 lakh."""
    price = F.bround(lakh * 100_000).cast("bigint")
    one = F.floor(price / 100).cast("bigint")
    return F.struct(
        price.alias("price"),
        F.when(lakh <= 5, F.greatest(one, F.lit(fixed.COMMISSION_MIN).cast("bigint"))).otherwise(one).alias("commission"),
        one.alias("one_percent"),
    )


def commission_answer(lakh: Column) -> Column:
    def say(c: Column) -> Column:
        parts = {"label": lakh_label(lakh), "price": money(c["price"]), "commission": money(c["commission"]), "one": money(c["one_percent"])}
        return F.when(lakh < 5, fill(S["commission_low"], **parts)).when(lakh == 5, fill(S["commission_even"], **parts)).otherwise(fill(S["commission_high"], **parts))

    return let(commission(lakh), say)


def car_phrase(car: Column, band: Column) -> Column:
    label = lookup(band, fixed.BAND_LABEL)
    return F.when(band.isin("small", "mid"), fill(S["car_small"], car=car, label=label)).otherwise(fill(S["car_body"], car=car, label=label))


def cc_phrase(cc: Column, band: Column) -> Column:
    """Eight hundred and eleven hundred take "An"."""
    article = F.when(cc.cast("string").rlike("^(8|11|18)"), F.lit("An")).otherwise(F.lit("A"))
    return fill(S["cc"], article=article, cc=cc.cast("string"), label=lookup(band, fixed.BAND_LABEL))


def priced(lead: Column, band: Column, service: str) -> Column:
    """The service's price sentence after a lead such as "For a Suzuki Alto (up to 1000cc),"."""
    verb = F.when(lead.startswith("The "), F.lit(S[f"{service}_verb_the"])).otherwise(F.lit(S[f"{service}_verb"]))
    return fill(S[service], lead=lead, verb=verb, price=lookup(band, fixed.INSPECTION_PRICE if service == "inspection" else fixed.SALE_FEE))


def price_answer(v: Column, service: str) -> Column:
    table = fixed.INSPECTION_PRICE if service == "inspection" else fixed.SALE_FEE
    lead = F.when(v["kind"] == "cc", cc_phrase(v["cc"], v["band"])).when(v["kind"] == "body", fill("For {name},", name=v["name"])).otherwise(car_phrase(v["name"], v["band"]))
    return (
        F.when(v["band"] == "large", F.lit(S[f"large_{service}"]))
        .when(v["band"] == "varies", fill(S[f"varies_{service}"], car=v["name"], small=table["small"], mid=table["mid"]))
        .otherwise(let(lead, lambda x: priced(x, v["band"], service)))
    )


def inspection_city_answer(city: Column, domain: Domain = DEFAULT) -> Column:
    where = F.when(city == "Lahore", fill(S["where_home"], brand=domain.brand)).otherwise(F.lit(S["where_other"]))
    return F.when(city.isin(*fixed.INSPECTION_CITIES), fill(S["inspection_yes"], brand=domain.brand, city=city, where=where)).otherwise(
        fill(S["inspection_no"], city=city, cities=name_list(fixed.INSPECTION_CITIES))
    )


def sale_city_answer(city: Column) -> Column:
    extra = F.when(city.isin(*fixed.INSPECTION_CITIES), fill(S["sifm_no_extra"], city=city)).otherwise(F.lit(""))
    return F.when(city.isin(*fixed.SALE_CITIES), fill(S["sifm_yes"], city=city)).otherwise(fill(S["sifm_no"], city=city, cities=name_list(fixed.SALE_CITIES), extra=extra))


def transfer_city_answer(city: Column, domain: Domain = DEFAULT) -> Column:
    return F.when(city.isin(*fixed.TRANSFER_CITIES), fill(S["transfer_yes"], brand=domain.brand, city=city)).otherwise(
        fill(S["transfer_no"], brand=domain.brand, city=city, cities=name_list(fixed.TRANSFER_CITIES))
    )


def featured_answer(label: Column) -> Column:
    days = lookup(label, fixed.FEATURED_LABELS)
    price = lookup(days, fixed.FEATURED_PRICE)
    return F.concat(F.when(label == "a month", fill(S["featured_month"], price=price)).otherwise(fill(S["featured"], days=days, price=price)), F.lit(S["featured_tail"]))


def bundle_answer(n: Column) -> Column:
    price = lookup(n.cast("int"), fixed.BUNDLE_PRICE)
    return F.when(price.isNotNull(), fill(S["bundle"], n=n.cast("string"), price=price)).otherwise(F.lit(S["bundles"]))


def model_year_answer(year: Column, car: Column) -> Column:
    subject = F.when(car.isNull(), F.concat(year.cast("string"), F.lit(" model car"))).otherwise(F.concat_ws(" ", year.cast("string"), car))
    return F.when(year < 2000, fill(S["year_no"], subject=subject)).otherwise(fill(S["year_yes"], subject=subject, cities=name_list(fixed.SALE_CITIES)))


# --- Facts ---------------------------------------------------------------------------------


def detect(message: Column, history: Column | None = None, domain: Domain = DEFAULT) -> Column:
    """Verified facts for a question, verdicts first: array<struct<service, text>>.

    A message of at most ten words that names no service takes those of the
    newest earlier question that does; what it asks about is its own.
    """
    return let(message, lambda m: _detect(m, history, domain))


def _detect(message: Column, history: Column | None, domain: Domain) -> Column:
    own = services(message, domain)
    if history is not None:
        earlier = let(own, lambda s: F.when((F.size(s) == 0) & (word_count(message) <= 10), previous_services(history, domain)).otherwise(s))
    else:
        earlier = own
    read = F.struct(
        F.coalesce(earlier, F.array().cast("array<string>")).alias("s"),
        cities(message).alias("cities"),
        vehicle(message).alias("v"),
        group(message, fixed.YEAR).cast("int").alias("year"),
        has(message, fixed.OPEN_LETTER).alias("open"),
        amount_in_lakh(message).alias("lakh"),
    )
    return let(read, lambda r: _facts(message, r, domain))


def _fact(service: str, text: Column) -> Column:
    return F.struct(F.lit(service).alias("service"), text.alias("text"))


def _facts(message: Column, r: Column, domain: Domain) -> Column:
    asks = lambda name: F.array_contains(r["s"], name)
    sale = asks("sifm") | asks("commission")
    year = r["year"].isNotNull()
    verdict = F.when(sale & r["open"], _fact("sifm", fill(S["open_letter"], brand=domain.brand))).when(
        sale & year, _fact("sifm", model_year_answer(r["year"], F.when(r["v"]["kind"] == "car", r["v"]["name"])))
    )
    by_city = F.flatten(
        F.transform(
            r["cities"],
            lambda c: F.array_compact(
                F.array(
                    F.when(asks("inspection"), _fact("inspection", inspection_city_answer(c, domain))),
                    F.when(asks("sifm"), _fact("sifm", sale_city_answer(c))),
                    F.when(asks("transfer"), _fact("transfer", transfer_city_answer(c, domain))),
                )
            ),
        )
    )
    auction = F.when(has(message, fixed.FEE_WORD), _fact("auction", F.lit(S["auction_fee"])))
    credits = group(message, fixed.CREDITS).try_cast("int")
    duration = one_of([(has(message, p), F.lit(label)) for label, p in fixed.DURATIONS])
    featured = F.when(
        asks("featured"),
        F.when(credits.isNotNull(), _fact("featured", bundle_answer(credits)))
        .when(duration.isNotNull(), _fact("featured", featured_answer(duration)))
        .when(has(message, fixed.DAYS), _fact("featured", F.lit(S["featured_options"]))),
    )
    known = r["v"].isNotNull()
    sold = F.when(sale & (F.coalesce(r["lakh"], F.lit(0.0)) != 0) & has(message, fixed.SALE), _fact("sifm", commission_answer(r["lakh"]))).when(
        asks("sifm") & known & ~(r["open"] | year), _fact("sifm", price_answer(r["v"], "sifm"))
    )
    inspected = F.when(
        asks("inspection"),
        F.when(has(message, fixed.NEW_CAR), _fact("inspection", F.lit(S["pdi"]))).when(known & ~asks("sifm"), _fact("inspection", price_answer(r["v"], "inspection"))),
    )
    prices = F.when(asks("auction"), F.array(auction)).otherwise(F.array(featured, sold, inspected))
    return F.array_compact(F.concat(F.array(verdict), by_city, prices))


def fact_block(facts: Column) -> Column:
    """The facts' sentences under their header, "" without facts."""
    return F.when(F.size(facts) > 0, F.concat(F.lit(fixed.FACT_HEADER + "\n"), F.array_join(F.transform(facts, lambda f: f["text"]), " "))).otherwise(F.lit(""))


def build_context(facts: Column, retrieved: Column) -> Column:
    """Verified facts first, so that cutting the context spares them, then what was retrieved."""
    return F.array_join(F.filter(F.array(fact_block(facts), F.coalesce(retrieved, F.lit(""))), lambda x: x != ""), fixed.CONTEXT_BREAK)


def strip_fact_block(context: Column) -> Column:
    rest = F.split(context, "\\n---\\n", 2)
    return F.when(context.startswith(fixed.FACT_HEADER), F.coalesce(F.get(rest, 1), F.lit(""))).otherwise(context)


def guard(answer: Column, context: Column, message: Column, history: Column | None = None, domain: Domain = DEFAULT) -> Column:
    """The answer, or a pointer to the right page if it quotes a figure that no source has."""
    turns = F.lit("") if history is None else F.coalesce(F.array_join(F.transform(history, lambda m: m["content"]), " "), F.lit(""))
    sources = F.concat_ws(" ", F.coalesce(context, F.lit("")), F.coalesce(message, F.lit("")), turns)
    named = services(F.coalesce(message, F.lit("")), domain)
    if history is not None:
        named = F.when(F.size(named) > 0, named).otherwise(previous_services(history, domain))
    page = F.coalesce(F.try_element_at(F.transform(named, lambda s: lookup(s, fixed.PAGES)), F.lit(1)), F.lit(f"the relevant page on {domain.site}"))
    safe = fill(S["guard"], page=page, brand=domain.brand, helpline=domain.helpline)
    return F.when(F.size(unsupported_figures(answer, sources)) == 0, answer).otherwise(safe)

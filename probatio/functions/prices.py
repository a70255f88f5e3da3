"""Price context of a sentence: what the amount is per, VAT, sizes, inclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.functions import text


def _amounts(text: Column, pattern: str) -> Column:
    raw = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.filter(
        F.transform(raw, lambda a: F.regexp_replace(a, r"[^0-9]", "").try_cast("bigint")),
        lambda a: a.isNotNull())


def _holds(lower: Column, pieces: tuple[str, ...]) -> Column:
    test = F.lit(False)
    for piece in pieces:
        test = test | lower.contains(piece)
    return test


def _states(body: Column, lower: Column, pattern: str, pieces: tuple[str, ...]) -> Column:
    """Whether the pattern matches; it runs only on texts that hold a piece of it."""
    return _holds(lower, pieces) & body.rlike(pattern)


def with_price_context(texts: DataFrame, column: str, name: str = "price") -> DataFrame:
    """Add the stated price context as a struct; NULL when there is no price.

    Built in steps so that each pattern runs once per row, and only on rows that
    carry an amount.
    """
    body = F.coalesce(F.col(column), F.lit(""))
    amounts = F.array_sort(F.array_distinct(F.concat(
        _amounts(body, fv.AMOUNT_PATTERN), _amounts(body, fv.AMOUNT_PREFIX_PATTERN))))
    lower = F.col("_lower")
    basis = F.coalesce(
        *[F.when(_states(body, lower, p, fv.BASIS_PIECES[label]), F.lit(label))
          for label, p in fv.BASIS_PATTERNS],
        F.when(_states(body, lower, fv.TOTAL_WORDS_PATTERN, fv.TOTAL_WORDS_PIECES),
               F.lit("TOTAL")), F.lit("UNKNOWN"))
    vat = (F.when(_states(body, lower, fv.VAT_INCLUDED_PATTERN, fv.VAT_INCLUDED_PIECES), "INCLUDED")
           .when(_states(body, lower, fv.VAT_EXCLUDED_PATTERN, fv.VAT_EXCLUDED_PIECES), "EXCLUDED")
           .otherwise("UNKNOWN"))
    battery = (
        F.when(_states(body, lower, fv.BATTERY_IN_PATTERN, fv.BATTERY_PIECES), F.lit(True))
        .when(_states(body, lower, fv.BATTERY_OUT_PATTERN, fv.BATTERY_PIECES), F.lit(False)))
    installed = (
        F.when(_states(body, lower, fv.INSTALLATION_IN_PATTERN, fv.INSTALLATION_IN_PIECES),
               F.lit(True))
        .when(_states(body, lower, fv.INSTALLATION_OUT_PATTERN, fv.INSTALLATION_OUT_PIECES),
              F.lit(False)))
    sized = _holds(lower, fv.SYSTEM_SIZE_PIECES)
    sizes = F.when(sized, F.concat(
        F.regexp_extract_all(body, F.lit(fv.SYSTEM_SIZE_PATTERN), F.lit(1)),
        F.regexp_extract_all(body, F.lit(fv.SYSTEM_SIZE_PATTERN), F.lit(2)))
    ).otherwise(text.string_array([]))
    sizes = F.array_sort(F.array_distinct(F.filter(
        F.transform(sizes, lambda s: F.regexp_replace(s, ",", ".").try_cast("double")),
        lambda s: s.isNotNull())))
    priced = F.size("_amounts") > 0
    found = text.once(texts, _amounts=F.when(body.rlike("[0-9]"), amounts), _lower=F.lower(body))
    read = text.once(
        found,
        _basis=F.when(priced, basis),
        _vat=F.when(priced, vat),
        _sizes=F.when(priced, sizes),
        _battery=F.when(priced, battery),
        _installed=F.when(priced, installed),
    )
    context = F.struct(
        F.col("_amounts").alias("amounts"),
        F.when(body.rlike(r"(?i)€|eur"), F.lit("EUR")).alias("currency"),
        F.col("_basis").alias("basis"),
        F.col("_vat").alias("vat_status"),
        F.col("_sizes").alias("system_size_kwp"),
        F.col("_battery").alias("battery_included"),
        F.col("_installed").alias("installation_included"),
        (F.size("_amounts") > 1).alias("is_range"),
        (F.col("_basis") != "UNKNOWN").alias("usable"),
    )
    return read.withColumn(name, F.when(priced, context)).drop(
        "_amounts", "_lower", "_basis", "_vat", "_sizes", "_battery", "_installed")


def _plain_number(value: Column) -> Column:
    text = value.cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.+$", "")


def describe(context: Column) -> Column:
    """One readable line about a price."""
    amounts, currency = context["amounts"], F.coalesce(context["currency"], F.lit(""))
    figure = F.when(
        context["is_range"],
        F.concat(amounts[0].cast("string"), F.lit("–"),
                 F.element_at(amounts, -1).cast("string"))
    ).otherwise(amounts[0].cast("string"))
    labels = F.create_map(*[F.lit(x) for kv in fv.BASIS_LABELS.items() for x in kv])
    vat = F.create_map(*[F.lit(x) for kv in fv.VAT_LABELS.items() for x in kv])
    sizes = F.concat_ws("–", F.transform(context["system_size_kwp"], _plain_number))
    return F.concat_ws(
        ", ",
        F.rtrim(F.concat_ws(" ", figure, currency)),
        labels[context["basis"]],
        F.when(F.size(context["system_size_kwp"]) > 0, F.concat(sizes, F.lit(" kWc"))),
        vat[context["vat_status"]],
        F.when(context["installation_included"], "installation included")
        .when(~context["installation_included"], "installation excluded"),
        F.when(context["battery_included"], "battery included")
        .when(~context["battery_included"], "battery excluded"),
    )


def qualification_label(category: Column) -> Column:
    return F.when(category == "MARKET_AVERAGE", "an average this source reports") \
        .otherwise("a figure this source reports")


# ------------------------------------------------------------------ display --
_THIN_SPACE = "\u202f"  # between thousands, as Belgian French writes them


def _label(value: Column, labels: dict[str, str], other: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(table[F.coalesce(value, F.lit(other))], F.lit(labels[other]))


def shown_basis(basis: Column) -> Column:
    """What a price is for; what the source did not say stays unsaid."""
    return _label(basis, fv.SHOWN_BASIS, "UNKNOWN")


def shown_vat(status: Column) -> Column:
    return _label(status, fv.SHOWN_VAT, "UNKNOWN")


def shown_qualification(category: Column) -> Column:
    """Only a reported average is called one."""
    return _label(category, fv.SHOWN_QUALIFICATION, "OTHER")


def shown_amount(value: Column, currency: Column) -> Column:
    """Whole euros from ten on, cents below; halves away from zero."""
    cents = F.round(value.cast("decimal(28, 6)"), 2)
    whole = F.round(value.cast("decimal(28, 6)"), 0).cast("decimal(28, 0)").cast("string")
    grouped = F.regexp_replace(whole, r"(?<=\d)(?=(\d{3})+$)", _THIN_SPACE)
    small = F.replace(_plain_number(cents), F.lit("."), F.lit(","))
    sign = F.when(F.coalesce(currency, F.lit("EUR")) == "EUR", "€").otherwise(currency)
    return F.concat_ws(" ", F.when(value < 10, small).otherwise(grouped), sign)


def shown_price(context: Column) -> Column:
    """One amount or both ends of a range; a dash without any."""
    amounts, currency = context["amounts"], context["currency"]
    low, high = F.get(amounts, F.lit(0)), F.element_at(amounts, -1)
    return (
        F.when(F.coalesce(F.size(amounts), F.lit(0)) < 1, "—")
        .when((F.size(amounts) == 1) | ~context["is_range"], shown_amount(low, currency))
        .otherwise(F.concat_ws(" – ", shown_amount(low, currency), shown_amount(high, currency))))


def shown_size(sizes: Column) -> Column:
    """System size in kWc, NULL when none is stated."""
    low, high = (_plain_number(c) for c in (F.get(sizes, F.lit(0)), F.element_at(sizes, -1)))
    return (F.when(F.size(sizes) == 1, F.concat(low, F.lit(" kWc")))
            .when(F.size(sizes) > 1, F.concat(low, F.lit("–"), high, F.lit(" kWc"))))

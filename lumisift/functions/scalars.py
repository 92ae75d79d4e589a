"""Scalar functions as Columns: text to dates and durations, calendar keys, URLs, hashes, sizes, vectors.

Instants are epoch milliseconds (BIGINT); calendar keys follow the session's time zone, which should be UTC.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and abbreviations, in English, French, and Spanish, Italian, Portuguese and German.
MONTHS = {
    "january": 1, "jan": 1, "february": 2, "feb": 2, "march": 3, "mar": 3, "april": 4, "apr": 4, "may": 5, "june": 6, "jun": 6,
    "july": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sept": 9, "sep": 9, "october": 10, "oct": 10, "november": 11,
    "nov": 11, "december": 12, "dec": 12,
    "janvier": 1, "janv": 1, "février": 2, "fevrier": 2, "févr": 2, "fevr": 2, "mars": 3, "avril": 4, "avr": 4, "mai": 5, "juin": 6,
    "juillet": 7, "juil": 7, "août": 8, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "décembre": 12, "decembre": 12, "déc": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8, "septiembre": 9, "octubre": 10,
    "noviembre": 11, "diciembre": 12, "gennaio": 1, "febbraio": 2, "aprile": 4, "maggio": 5, "giugno": 6, "luglio": 7, "settembre": 9,
    "ottobre": 10, "dicembre": 12, "janeiro": 1, "fevereiro": 2, "maio": 5, "junho": 6, "julho": 7, "setembro": 9, "outubro": 10,
    "novembro": 11, "dezembro": 12, "januar": 1, "februar": 2, "maerz": 3, "märz": 3, "juli": 7, "oktober": 10, "dezember": 12,
}
#: Width over height of common screens.
SCREEN_RATIOS = (9 / 16, 9 / 18, 9 / 19.5, 9 / 20, 9 / 21, 10 / 16, 16 / 9, 18 / 9, 19.5 / 9, 20 / 9, 21 / 9, 16 / 10)


def instant(year: Column, month: Column, day: Column) -> Column:
    """Midnight of a date: null outside 1900-2200, months and days clamped, days beyond the month's end roll over."""
    first = F.make_date(F.when(year.between(1900, 2200), year), F.least(F.lit(12), F.greatest(F.lit(1), month)), F.lit(1))
    return F.unix_millis(F.date_add(first, F.least(F.lit(31), F.greatest(F.lit(1), day)) - 1).cast("timestamp"))


def month_number(name: Column) -> Column:
    key = F.regexp_replace(F.lower(name), r"\.$", "")
    exact = F.try_element_at(F.create_map(*map(F.lit, chain(*MONTHS.items()))), key)
    names = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in sorted(MONTHS.items(), key=lambda x: -len(x[0]))])
    prefixed = F.get(F.filter(names, lambda x: x["k"].startswith(key) & (F.length(key) >= 3)), F.lit(0))["v"]
    return F.when(key != "", F.coalesce(exact, prefixed))


def _let(value: Column, then) -> Column:
    """then(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _clock(text: Column) -> Column:
    """Milliseconds after midnight of the first time that follows a comma or a word for "at", else 0."""
    found = F.regexp_extract(text, r"(?:,\s*|\b(?:at|um)\s+)(\d\d?(?::\d\d){1,2}(?:\s*(?:[AP]M|[ap]m))?)", 1)

    def millis(at: Column) -> Column:
        parts, half = F.split(F.regexp_extract(at, "^[0-9:]+", 0), ":"), F.lower(F.right(at, F.lit(2)))
        hour = F.get(parts, F.lit(0)).try_cast("int")
        hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
        seconds = hour * 3600 + F.get(parts, F.lit(1)).try_cast("int") * 60 + F.coalesce(F.get(parts, F.lit(2)).try_cast("int"), F.lit(0))
        return F.when(at != "", seconds.cast("long") * 1000).otherwise(F.lit(0).cast("long"))

    return _let(found, millis)


def _numbers(found: Column, *order: int) -> list[Column]:
    """The numbers of a date in figures by their places; one plain character is split at without a regular expression."""
    parts = F.split(F.translate(found, "./", "--"), "-")
    return [F.get(parts, F.lit(i)).try_cast("int") for i in order]


def _named(text: Column, pattern: str, day: str | None) -> Column:
    """The first stretch of this form whose word is a month's name, as an instant; day: whether its number comes first or second."""
    months = F.create_map(*map(F.lit, chain(*MONTHS.items())))
    month = lambda x: F.try_element_at(months, F.lower(F.regexp_extract(x, r"\p{L}{3,}", 0)))

    def when(x: Column) -> Column:
        numbers = F.regexp_extract_all(x, F.lit(r"\d+"), F.lit(0))
        number = lambda i: F.get(numbers, F.lit(i)).try_cast("int")
        return instant(number(1 if day else 0), month(x), number(0) if day else F.lit(1))

    found = F.get(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: month(x).isNotNull()), F.lit(0))
    return _let(found, when)


#: Forms of dates in labels; a word stands where a month's name must be. Each is looked for once, and the parts are taken from what is found.
DATE_FORMS = {
    "year first": r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
    "day, word, year": r"\b\d{1,2}(?:\s*[eE][rR])?\s+\p{L}{3,}\.?\s*,?\s+\d{4}\b",
    "word, day, year": r"\b\p{L}{3,}\.?\s+\d{1,2}\s*,?\s+\d{4}\b",
    "year last": r"\b\d{1,2}[./-]\d{1,2}[./-]\d{4}\b",
    "digits": r"\b\d{8}\b",
    "word, year": r"\b\p{L}{3,}\.?\s+\d{4}\b",
    "year": r"\b(?:19|20)\d{2}\b",
}


def parse_date(text: Column) -> Column:
    """struct(ts, precision) of the first date that a label holds, or null."""
    # what wasn't found is kept from casts: each that fails costs an exception
    first = {name: F.regexp_extract(text, form, 0) for name, form in DATE_FORMS.items()}

    def year_last(found: Column) -> Column:
        d, m, y = _numbers(found, 0, 1, 2)
        swap = (m > 12) & (d <= 12)
        return F.when(found != "", instant(y, F.when(swap, d).otherwise(m), F.when(swap, m).otherwise(d)))

    part = lambda x, a, n: F.substring(x, a, n).try_cast("int")
    days = [
        _let(first["year first"], lambda x: F.when(x != "", instant(*_numbers(x, 0, 1, 2)))),
        _named(text, DATE_FORMS["day, word, year"], "first"),
        _named(text, DATE_FORMS["word, day, year"], "first"),
        _let(first["year last"], year_last),
        _let(first["digits"], lambda x: F.when(x != "", instant(part(x, 1, 4), part(x, 5, 2), part(x, 7, 2)))),
    ]
    month = _named(text, DATE_FORMS["word, year"], None)
    year = _let(first["year"], lambda x: F.when(x != "", instant(x.try_cast("int"), F.lit(1), F.lit(1))))
    dated = lambda ts, precision: F.when(ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(precision).alias("precision")))
    found = F.coalesce(_let(F.coalesce(*days), lambda d: dated(d + _clock(text), "day")), _let(month, lambda m: dated(m, "month")), _let(year, lambda y: dated(y, "year")))
    return F.when(text.rlike(r"\d{4}"), found)


#: Words that say a label is of a video, that it is of a film, and that it gives a length.
VIDEO_WORDS, FILM_WORDS, LENGTH_WORDS = ("video", "vidéo"), ("film", "movie"), ("duration", "durée", "duree", "length")


def _speaks_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), F.array(*map(F.lit, words)))


def parse_duration(text: Column) -> Column:
    """Seconds of m:ss or h:mm:ss where the label speaks of a video or a length, or is nothing else."""

    def seconds(found: Column) -> Column:
        parts = F.split(found, ":")
        a, b, c = (F.get(parts, F.lit(i)).try_cast("long") for i in range(3))
        return F.when(found != "", F.when(F.size(parts) > 2, a * 3600 + b * 60 + c).otherwise(a * 60 + b))

    def bare(parts: Column) -> Column:
        return F.size(parts).between(2, 3) & F.get(parts, F.lit(0)).rlike(r"^\d{1,2}$") & F.forall(F.slice(parts, 2, 2), lambda p: p.rlike(r"^\d{2}$"))

    told = _speaks_of(text, VIDEO_WORDS + LENGTH_WORDS) | _let(F.split(F.btrim(text, F.lit(" \t\n\v\f\r")), ":"), bare)
    return F.when(told, _let(F.regexp_extract(text, r"\b\d{1,2}(?::\d{2}){1,2}\b", 0), seconds)).cast("long")


def is_video_label(text: Column) -> Column:
    return F.coalesce(_speaks_of(text, VIDEO_WORDS + FILM_WORDS), F.lit(False))


def moment(ts: Column) -> Column:
    return F.timestamp_millis(ts)


def day_key(ts: Column) -> Column:
    return F.date_format(moment(ts), "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(moment(ts), "yyyy-MM")


def year_key(ts: Column) -> Column:
    return F.date_format(moment(ts), "yyyy")


def format_date(ts: Column, precision: Column) -> Column:
    t = moment(ts)
    text = F.when(precision == "year", F.date_format(t, "yyyy")).when(precision == "month", F.date_format(t, "MMMM yyyy")).otherwise(F.date_format(t, "d MMM yyyy"))
    return F.when(ts.isNull(), "Unknown date").otherwise(text)


def months_ago(n: int, today: Column | None = None) -> Column:
    """Midnight n months ago; at a month's end the day is clamped."""
    return F.unix_millis(F.add_months(F.current_date() if today is None else today, -n).cast("timestamp"))


def is_image_host(url: Column) -> Column:
    """Whether an http(s) URL's host is one of the image hosts, not merely contains one."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    known = host.rlike(r"(?:^|\.)(?:googleusercontent\.com|ggpht\.com|usercontent\.google\.com)$|^lh\d+\.google\.com$")
    return F.coalesce(url.rlike(r"(?i)^https?://") & known, F.lit(False))


def with_thumb_size(url: Column, size: int) -> Column:
    """Sets the size suffix before the query; null for null and empty."""
    base, query = F.regexp_extract(url, r"^([^?]*)", 1), F.regexp_extract(url, r"(\?[\s\S]*)$", 1)
    return F.when(url != "", F.concat(F.regexp_replace(base, r"=[-\w]*$", ""), F.lit(f"=w{size}-h{size}"), query))


def thumb_url(base: Column, size: int, account: Column | None = None) -> Column:
    sized = with_thumb_size(base, size)
    if account is None:
        return sized
    return F.when(account.isNotNull() & ~sized.contains("?"), F.concat(sized, F.lit("?authuser="), account.cast("string"))).otherwise(sized)


def account_of(path: Column) -> Column:
    """The n of a path that begins with /u/n/."""
    return F.regexp_extract(path, r"^/u/(\d+)/", 1).try_cast("int")


def rendition(url: Column, raw: Column, video: Column) -> dict[str, Column]:
    base = F.substring_index(F.coalesce(raw, url), "=", 1)
    return {"still": F.concat(base, F.lit("=w1600-h1600")), "stream": F.when(video, F.concat(base, F.lit("=m18")))}


def hash_halves(hex16: Column) -> tuple[Column, Column]:
    """A 64-bit hash in hex as two numbers of 32 bits; null unless it has 16 digits."""
    ok = hex16.rlike("^[0-9a-fA-F]{16}$")
    return tuple(F.when(ok, F.conv(F.substring(hex16, at, 8), 16, 10).cast("long")) for at in (1, 9))


def hamming_halves(a_hi: Column, a_lo: Column, b_hi: Column, b_lo: Column) -> Column:
    """Bits that differ, 64 with a missing side."""
    return F.coalesce(F.bit_count(a_hi.bitwiseXOR(b_hi)) + F.bit_count(a_lo.bitwiseXOR(b_lo)), F.lit(64))


def hamming(a: Column, b: Column) -> Column:
    return hamming_halves(*hash_halves(a), *hash_halves(b))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def round_up(x: Column, digits: int) -> Column:
    """Half up toward plus infinity, on doubles."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def screen_aspect(width: Column, height: Column) -> Column:
    a = width.cast("double") / height.cast("double")
    off = F.array_min(F.array(*[F.abs(a - F.lit(t)) / F.lit(t) for t in SCREEN_RATIOS]))
    return F.when((width > 0) & (height > 0), clamp01(F.lit(1.0) - off / F.lit(0.035))).otherwise(F.lit(0.0))


def format_bytes(n: Column) -> Column:
    """In steps of 1024; whole numbers for bytes and from 100 on, else one decimal."""
    n = F.coalesce(n, F.lit(0)).cast("double")
    out = None
    for power, unit in enumerate(("B", "KB", "MB", "GB", "TB")):
        v = n / F.lit(float(1024**power))
        text = F.concat(F.when((v >= 100) | F.lit(power == 0), F.format_string("%d", F.floor(v + F.lit(0.5)))).otherwise(F.format_string("%.1f", v)), F.lit(f" {unit}"))
        out = F.when(v < 1024, text) if out is None else out.when((v < 1024) | F.lit(unit == "TB"), text)
    return out


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + F.lit(0.5)).cast("string"), F.lit("%"))


def number_text(n: Column) -> Column:
    """With thousands separators; null is 0."""
    return F.format_number(F.coalesce(n, F.lit(0)), 0)


def date_input(ts: Column) -> Column:
    """As a date field takes it: empty without a date."""
    return F.coalesce(day_key(ts), F.lit(""))


def duration_text(seconds: Column) -> Column:
    """45s, 2 min, 2m05."""
    m, s = F.floor(seconds / 60), seconds % 60
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).when(s == 0, F.concat(m.cast("string"), F.lit(" min"))).otherwise(F.concat(m.cast("string"), F.lit("m"), F.lpad(s.cast("string"), 2, "0")))


def item_bytes(space_taken: Column, size_bytes: Column) -> Column:
    """The space an item takes, else its size; zero and null are unknown, as 0."""
    zero = F.lit(0).cast("long")
    return F.coalesce(F.nullif(space_taken, zero), F.nullif(size_bytes, zero), zero)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    """As a unit vector of doubles; zero stays zero, an empty one is an error."""
    length = F.sqrt(dot(v, v))
    unit = F.when(length > 0, F.transform(v, lambda x: x.cast("double") / length)).otherwise(F.transform(v, lambda x: x.cast("double")))
    return F.when(F.size(v) == 0, F.raise_error(F.lit("empty vector")).cast("array<double>")).otherwise(unit)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return F.lit(1.0) - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))


def group_label(name: Column, group: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Person "), (group + 1).cast("string")))

"""CAS numbers and hazard / precautionary codes, as Catalyst expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The hazard statement codes that count as known.
H_CODES = """
H200 H201 H202 H203 H204 H205 H206 H207 H208
H220 H221 H222 H223 H224 H225 H226 H227 H228 H229 H230 H231 H232
H240 H241 H242 H250 H251 H252 H260 H261 H270 H271 H272
H280 H281 H282 H283 H284 H290
H300 H301 H302 H303 H304 H305 H310 H311 H312 H313 H314 H315 H316 H317 H318 H319 H320
H330 H331 H332 H333 H334 H335 H336 H340 H341 H350 H351 H360 H361 H362 H370 H371 H372 H373
H400 H401 H402 H410 H411 H412 H413 H420
""".split()

# The precautionary statement codes that count as known.
P_CODES = """
P101 P102 P103 P201 P202 P210 P211 P212 P220 P221 P222 P223 P230 P231 P232 P233 P234 P235
P240 P241 P242 P243 P244 P250 P251 P260 P261 P262 P263 P264 P270 P271 P272 P273
P280 P281 P282 P283 P284 P285
P301 P302 P303 P304 P305 P306 P307 P308 P309 P310 P311 P312 P313 P314 P315 P316 P317 P318
P320 P321 P322 P330 P331 P332 P333 P334 P335 P336 P337 P338 P340 P341 P342
P350 P351 P352 P353 P360 P361 P362 P363 P364 P370 P371 P372 P373 P374 P375 P376 P377 P378
P380 P381 P390 P391 P401 P402 P403 P404 P405 P406 P407 P410 P411 P412 P413 P420 P422 P501 P502 P503
""".split()

CAS_FORMAT = r"^[0-9]{2,7}-[0-9]{2}-[0-9]$"
QC_CAS_FORMAT = r"^[0-9]{1,7}-[0-9]{2}-[0-9]$"


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``, which works ``value`` out once however often it names it. A filter on
    the result that moves below a projection writes out what ``value`` is made of once, too."""
    return F.transform(F.array(value), of)[0]


def _check_digit(cas: Column) -> Column:
    """The digit of a number that looks like a CAS number."""
    place = lambda n, i: F.call_function("div", n, F.lit(10**i)) % 10 * i
    total = lambda n: sum((place(n, i) for i in range(2, 10)), place(n, 1))
    return _once(F.translate(cas, "-", "").try_cast("long"), lambda n: (total(n) % 10).cast("int"))


def cas_check_digit(cas: Column) -> Column:
    """The digit that a CAS number should end with: its other digits, from the right,
    times 1, 2, 3 ..., modulo 10. Null unless the string looks like a CAS number."""
    return _once(cas, lambda c: F.when(c.rlike(QC_CAS_FORMAT), _check_digit(c)))


def cas_status(cas: Column, pattern: str = CAS_FORMAT) -> Column:
    """``ok``, ``format`` or ``checkdigit``; null for null."""
    last = lambda c: F.substring(c, -1, 1).cast("int")
    return _once(cas, lambda c: F.when(c.isNull(), F.lit(None).cast("string")).when(~c.rlike(pattern), "format").when(c.rlike(QC_CAS_FORMAT) & (_check_digit(c) == last(c)), "ok").otherwise("checkdigit"))


def cas_fixed(cas: Column) -> Column:
    """The number with the check digit that it should have; others unchanged."""
    fixed = lambda c: F.concat(F.regexp_replace(c, "[0-9]$", ""), _check_digit(c).cast("string"))
    return _once(cas, lambda c: F.when(c.rlike(CAS_FORMAT), fixed(c)).otherwise(c))


def split_cas(texts: Column) -> Column:
    """Array of CAS strings with several numbers in one entry taken apart."""
    parts = F.flatten(F.transform(texts, lambda x: F.split(x, r"[\n\r,;]")))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def known_h(code: Column) -> Column:
    return F.upper(code).isin(H_CODES)


def known_p(code: Column) -> Column:
    """Every ``+``-joined part is known."""
    known = F.array(*map(F.lit, P_CODES))
    return F.forall(F.split(F.upper(code), r"\+"), lambda x: F.array_contains(known, F.trim(x)))


def repeats_of(codes: Column) -> Column:
    """Entries that have an equal entry (after upper-casing) before them, in order."""
    upper = F.transform(F.filter(codes, lambda c: c.isNotNull()), lambda c: F.upper(c))
    return F.filter(upper, lambda c, i: F.array_position(upper, c) <= i)

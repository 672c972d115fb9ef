"""A plain version of the format-preserving pseudonyms, value by value."""

import datetime
import hashlib

import regex

from quirefold.llm import pii

FIRST = datetime.date(1800, 1, 1).toordinal()


def sha(*parts, bits=256):
    return hashlib.new(f"sha{bits}", "|".join(parts).encode()).hexdigest()


def shifted(half, other, key, kind, turn, alphabets):
    stream = sha(key, kind, str(turn), str(len(half)), other, key, bits=512)
    out = []
    for i, c in enumerate(half):
        by = int(stream[(i * 4) % 125 : (i * 4) % 125 + 4], 16)
        for a in alphabets:
            if c in a:
                c = a[(a.index(c) + by) % len(a)]
                break
        out.append(c)
    return "".join(out)


def permuted(value, key, kind, alphabets=pii.PLAIN):
    cut = len(value) // 2
    a, b = value[:cut], value[cut:]
    for turn in range(pii.ROUNDS):
        if turn % 2 == 0:
            a = shifted(a, b, key, kind, turn, alphabets)
        else:
            b = shifted(b, a, key, kind, turn, alphabets)
    return a + b


def pair(a, b, n, m, key, kind):
    for turn in range(pii.ROUNDS):
        shift = lambda other: int(sha(key, kind, str(turn), str(other), key)[:15], 16)  # noqa: B023, E731
        if turn % 2 == 0:
            a = (a + shift(b)) % n
        else:
            b = (b + shift(a)) % m
    return a, b


def refilled(form, new):
    it = iter(new)
    return "".join(next(it, "") if c.isascii() and c.isalnum() else c for c in form)


def mod97(plain):
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def luhn(plain):
    total = 0
    for i, c in enumerate(reversed(plain)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits(v):
    return "".join(c for c in v if c in "0123456789")


def date(v, key):
    iso = v[4] == "-"
    y, m, d = (int(x) for x in (v.split("-") if iso else reversed(v.replace("/", ".").split("."))))
    try:
        day = datetime.date(y, m, d).toordinal() - FIRST
    except ValueError:
        return v
    era, at = divmod(day, pii.DAYS)
    if not pii.ERAS[0] <= era <= pii.ERAS[1]:
        return v
    a, b = pair(at // pii.DAY_COLUMNS, at % pii.DAY_COLUMNS, pii.DAY_ROWS, pii.DAY_COLUMNS, key, "date")
    new = datetime.date.fromordinal(FIRST + era * pii.DAYS + a * pii.DAY_COLUMNS + b).isoformat()
    return new if iso else v[2].join((new[8:], new[5:7], new[:4]))


def valid_ssn(v):
    return regex.match("(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", v)


def ssn(v, key):
    areas = [n for n in range(1, 900) if n != 666]
    area, group, serial = map(int, v.split("-"))
    a, b = pair(areas.index(area), (group - 1) * 9999 + serial - 1, len(areas), 99 * 9999, key, "ssn")
    return f"{areas[a]:03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"


def changed(kind, v, key):
    if kind == "email":
        name, _, host = v.partition("@")
        return permuted(name, key, kind) + "@" + host
    if kind == "secret":
        return permuted(v, key, kind, pii.HEX)
    if kind == "iban":
        plain = v.replace(" ", "")
        if mod97(plain) != 1:
            return v
        body = permuted(plain[4:], key, kind)
        return refilled(v, f"{plain[:2]}{98 - mod97(plain[:2] + '00' + body):02d}{body}")
    if kind == "ip":
        parts = v.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return v
        a, b = pair(int(parts[0]) * 256 + int(parts[1]), int(parts[2]) * 256 + int(parts[3]), 65536, 65536, key, "ip")
        return ".".join(str(x) for h in (a, b) for x in divmod(h, 256))
    if kind == "date":
        return date(v, key)
    if kind == "ssn":
        return ssn(v, key) if valid_ssn(v) else v
    if kind == "phone":
        if not 7 <= len(digits(v)) <= 15:
            return v
        code = (regex.match(r"\+[0-9]{1,3}(?![0-9])", v) or [""])[0]
        return code + refilled(v[len(code) :], permuted(digits(v[len(code) :]), key, kind))
    plain = digits(v)
    if not luhn(plain):
        return v
    body = permuted(plain[:-1], key, kind)
    return refilled(v, next(body + str(d) for d in range(10) if luhn(body + str(d))))


def pseudonymised(text, key):
    def put(match):
        kind = next(k for k, p in pii.KINDS.items() if regex.fullmatch(p, match[0]))
        return changed(kind, match[0], key)

    return None if text is None else regex.sub(pii.ANY, put, text)

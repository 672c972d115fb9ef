"""Wrapped and placed lines, one character and one line at a time, in whole hundredths and thousandths."""

from quirefold.operators import typesetting as T


def width(c):
    if c.isascii():
        return 30 if c in " \t\n\f\r" else 52
    return 100 if any(a <= ord(c) <= b for a, b in T.FULL_WIDTH) else 82


def wrap(text, first, full):
    out = []
    for source in (text or "").split("\n"):
        if not source.strip():
            continue
        line, used = "", 0
        for c in source:
            w = width(c)
            if line and used + w > (full if out else first):
                out.append(line)
                line, used = "", 0
            line, used = line + c, used + w
        out.append(line)
    return out or [""]


def placed(items, font_scale=1.0, margin_scale=1.0):
    """(page, seq, line number, y, line) of (seq, role, text)."""
    styles = T.measures(font_scale, margin_scale)
    top, bottom = T.milli(T.PAGE_H - T.MARGIN_TOP * margin_scale), T.milli(T.MARGIN_BOTTOM * margin_scale)
    page, y, started, out = 1, top, False, []
    for seq, role, text in sorted(items):
        m = styles.get(role, styles["Body"])
        if started and y < top:
            y -= m["before"]
        for k, line in enumerate(wrap(text, m["first"], m["full"])):
            if started and y - m["step"] < bottom:
                page, y = page + 1, top
            started = True
            y -= m["step"]
            out.append((page, seq, k, y / 1000.0, line))
        y -= m["after"]
    return out

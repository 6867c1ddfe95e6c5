"""Plain models of the log rules, written for the tests only.

They state the rules over whole texts: where entries open, and what lies between.
"""

import json
import re
from itertools import pairwise

from annalist.functions import text as rules

OPENER = re.compile(rules.OPENER)


def entries(lines):
    """Entries of one stream: the slices between the positions of opening lines."""
    opening = [n for n, line in enumerate(lines) if OPENER.match(line)]
    return ["\n".join(lines[a:b]).strip() for a, b in pairwise([*opening, len(lines)])]


def fenced(text, tag="json"):
    """Bodies of fences: from one mark to the next of the same kind, then on behind it."""
    bodies, at = [], 0
    while True:
        marks = [(text.find(mark, at), mark) for mark in ("```", "~~~")]
        closed = [(a, mark) for a, mark in marks if a >= 0 and text.find(mark, a + 3) >= 0]
        if not closed:
            return bodies
        start, mark = min(closed)
        end = text.find(mark, start + 3)
        bodies.append(text[start + 3 : end].removeprefix(tag))
        at = end + 3


def is_object(body):
    try:
        return isinstance(json.loads(body), dict)
    except ValueError:
        return False


def parsed(entry):
    """(date, level, process, module, line, content) or None."""
    head = entry.split("|", 2)
    if len(head) != 3:
        return None
    where, content = [*head[2].split("-", 1), ""][:2]
    names = [n.strip() for n in where.strip().split(":")]
    number = names[2] if len(names) > 2 else ""
    if not number.lstrip("+-").isdecimal() or len(number) - len(number.lstrip("+-")) > 1 or not number.isascii():
        return None
    if not all(map(is_object, fenced(content))):
        return None
    return head[0].strip(), head[1].strip(), names[0], names[1], int(number), content


def header(text):
    """What stands between the first two triple stars of a line, or None."""
    for line in re.split("\n", text):
        first = line.find("***")
        second = line.find("***", first + 3)
        if first >= 0 and second >= 0:
            return line[first + 3 : second]
    return None


def key_values(text):
    """Pairs read from left to right: a name, an equals sign, then a quoted or a bare value."""
    pairs, at = {}, 0
    while (sign := text.find("=", at)) >= 0:
        start = sign
        while start > at and (text[start - 1].isalnum() or text[start - 1] == "_"):
            start -= 1
        name, rest = text[start:sign], text[sign + 1 :]
        line = rest.split("\n", 1)[0]
        if not name:
            at = sign + 1
        elif rest.startswith('"') and '"' in line[1:]:
            pairs[name] = line[1 : line.index('"', 1)]
            at = sign + 2 + line.index('"', 1)
        else:
            value = re.split(r"\s", rest, maxsplit=1)[0]
            if value:
                pairs[name] = value
            at = sign + 1 + len(value)
    return pairs

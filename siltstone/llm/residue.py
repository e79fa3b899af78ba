"""Template residue, filler text, error pages and script notices.

Lines are normalised (case, blanks, numbers) and counted by host (the source column). A line that stands
beside other content in most documents of a host is its boilerplate and is subtracted (but never the whole of a text). What is left of a
document is judged by what it is composed of: each fragment (a line, the lines of one cue together, what
stands between tags or in JSON strings) that is, as a whole, a message of the kinds in
`siltstone.llm.messages` is evidence, as is an unfilled placeholder anywhere; speech that mentions such
things holds words or speakers that no message has. Fragments are compared in a form in which markup,
accents, recognition errors and wrong encodings do not matter. Wordings that a dialogue could have too
are evidence only where nothing else is left of the text.

Scale: all lines are counted by hash, first within a batch of texts, then with map-side combine, so a host with a
third of all documents is no hot key. At most (lines a document) / RECURRENT lines of a host can be boilerplate. Judging comes before
subtracting: as a line's evidence does not depend on other lines, judging what is left gives the same rows, and
one Arrow pass over the texts yields the counts and the few lines that hold evidence. Nothing is collected.
"""

from __future__ import annotations

import codecs
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm import messages
from siltstone.session import checked_broadcast, materialise, spread

#: A line beside other content in more than this share of a host's documents, and in MIN_DOCUMENTS or more,
#: is its boilerplate.
RECURRENT = 0.5
MIN_DOCUMENTS = 5
#: In texts of so few lines every line is judged, as wordings that count alone need no anchor.
LONE = 3
#: Letters that the start of a word must have to stand for all words that begin so.
STEM = 5
#: One word in so many may be one that no message has: a name of a site or a product.
STRANGE = 10

#: The running filler text; any four words of it in a row are filler.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua "
    "ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat "
    "duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur "
    "excepteur sint occaecat cupidatat non proident sunt in culpa qui officia deserunt mollit anim id est laborum"
)
#: Names of template variables that, in single braces, are no remark of a speaker.
VARIABLES = (
    "character studio speaker sponsor season lang language slot ad date price phone logo image link address message team group credits location translator fps title name username user date author text line channel year "
    "email url episode number host guest actor company product city country station studioname subtitle caption"
).split()

#: Names of the signs around a variable; a speaker who has just named one spells it out.
SIGNS = [
    "dollar sign", "percent sign", "hash sign", "pound sign", "at sign", "ampersand", "curly brace", "curly bracket", "square bracket", "angle bracket", "double brace", "double bracket", "braces", "brackets", "underscore",
    "signo de dólar", "signo de porcentaje", "arroba", "llaves", "corchetes", "guion bajo", "signe dollar", "signe pour cent", "accolade", "crochet", "tiret bas", "Dollarzeichen", "Prozentzeichen", "Klammeraffe",
    "geschweifte Klammer", "geschweiften Klammer", "eckige Klammer", "eckigen Klammer", "Unterstrich", "cifrão", "sinal de dólar", "sinal de porcentagem", "chaves", "colchetes",
]

_ID = r"[A-Za-z][\w.]*"
_ARG = rf"(?:{_ID}(?:\[\w+\])*|'[^'\n]*'|\"[^\"\n]*\")"
_PLACEHOLDER = re.compile(
    rf"\{{\{{\{{?\s*(?:[#/^>&@!]\s*{_ID}(?:\s+{_ID})*|{_ARG}\s*(?:\|[^{{}}\n]*)?)\s*\}}\}}\}}?|\{{%-?\s*(?:{_ID}|(?:if|for|else|elif|block|include|extends|set|with|load|trans|url)\s[^{{}}%\n]*?)\s*-?%\}}"
    rf"|<%[=#-]?\s*@?{_ID}\s*%>|<\?(?:php|=)[^<>\n]*\?>|</?#(?:list|if|else|assign|include)\b[^<>\n]*>|<<\s*{_ID}\s*>>|&[lI1]t;\s*{_ID}\s*&gt;|\[\[\s*{_ID}\s*\]\]|[$#]\{{\s*{_ID}\s*\}}|%\{{{_ID}\}}"
    rf"|%\({_ID}\)[sd]|(?<![\w%])%{_ID}%(?![\w%])|(?<![\w$])\${_ID}\$(?![\w$])|@@{_ID}@@|(?<!\w)__[A-Za-z](?:[\w.]*[A-Za-z0-9])?__(?!\w)|XX_{_ID}_XX"
    rf"|\[(?:[Ii1l][Nn][Ss5][Ee3c][Rr][Tt]\s[^\[\]\n]{{2,}}|[^\[\]\n]{{2,}}\s[Hh][Ee3c][Rr][Ee3c]|[Yy][Oo0][Uu][Rr]\s(?P<own>[^\[\]\n]{{2,}}))\]|(?P<single>(?<![{{$#\\%])\{{{_ID}\}}(?!\}}))"
)
_HINT = re.compile(r"\{\{|\{%|[%@$\[]|\{[A-Za-z]|<<|<[%?]|</?#|&[lI1]t;|__|XX_")
_CUT = re.compile(r"[\r\n\x0b\x0c\x85  ]+|</?[A-Za-z0-9!?][^<>\n]*>|\{\\[^{}\n]*\}|\"\s*[:,]\s*\"|\{\s*\"|\"\s*\}")
_NUMBER = re.compile(r"\b\d+\b")
#: Folds recognition errors: e read as c, l and i as I or 1, o as 0, s as 5, b as 8; see also _fold.
_LATIN = bytes.maketrans(b"cl0158", b"eioisb")
_NO_LETTER = bytes(b for b in range(128) if not chr(b).isalnum()) + b"234679"
_NO_LETTER_NOR_LINE = _NO_LETTER.replace(b"\n", b"")
_OTHER = re.compile(r"[\W\d_]+")
_WRONG = re.compile("[À-ÿ][\u0080-¿Œ-™]|[РСГВЃѓ][\u0080-¿Ђ-Џђ-џ–-™]|[ÐÑØÙã]")
_OTHER_SCRIPT = re.compile("[Ѐ-ӿ؀-ۿ぀-ヿ一-鿿]")
_TODO = re.compile(r"[\s\[(<*#-]*(?:TO ?DO|TBD|tbd)[\s\])>*:.-]*")
#: Lines of a subtitle file that are neither speech nor message.
_FRAME = re.compile(r"[\W\d_]*|\W*WEBVTT.*|.*-->.*|(?:Kind|Language): \S+")

def _fold(text: str) -> str:
    """ASCII letters only, without accented ones, recognition errors folded, numbers kept out."""
    return _quick(_NUMBER.sub(" ", text))


def _quick(text: str) -> str:
    return _folded(text, _NO_LETTER)


def _folded(text: str, dropped: bytes) -> str:
    folded = text.lower().encode("ascii", "ignore").translate(_LATIN, dropped)
    return folded.replace(b"rn", b"m").replace(b"vv", b"w").decode("ascii")


def _letters(text: str) -> str:
    """Letters of any script in lower case."""
    return _OTHER.sub("", text.lower())


@lru_cache(1)
def _bytes_of() -> list[dict[int, int]]:
    """Characters to bytes of the encodings texts were wrongly read in; C1 controls are themselves."""
    out = []
    for name in ("latin-1", "cp1252", "cp1251"):
        table = {0x80 + i: 0x80 + i for i in range(32)}
        for b in range(256):
            try:
                table[ord(bytes([b]).decode(name))] = b
            except UnicodeDecodeError:
                pass
        out.append(table)
    return out


_AS_UTF8 = "siltstone.utf8"
codecs.register_error(_AS_UTF8, lambda e: (e.object[e.start : e.end].encode("utf-8", "replace"), e.end))


def repair(text: str) -> str:
    """The text with UTF-8 that was read in an 8-bit encoding read again; unchanged where it wasn't."""
    if not _WRONG.search(text):
        return text
    best, least = text, text.count("�") + len(_WRONG.findall(text))
    for table in _bytes_of():
        raw = codecs.charmap_encode(text, _AS_UTF8, table)[0]  # type: ignore[attr-defined]
        again = raw.decode("utf-8", "replace")
        bad = again.count("�") + len(_WRONG.findall(again))
        if bad < least:
            best, least = again, bad
    return best


def _lorem_runs() -> list[list[str]]:
    """The running filler text, and as shortened versions have it, without small words."""
    words = LOREM.split() + LOREM.split()[:3]
    return [words, [w for w in words if w != "ut"], [w for w in words if w not in ("ut", "in", "dolor", "dolore", "eu")]]


@lru_cache(1)
def _lorem() -> set[str]:
    return {"".join(map(_quick, run[i : i + 4])) for run in _lorem_runs() for i in range(len(run) - 3)}


def _is_lorem(folded: str) -> bool:
    return len(folded) >= 12 and any(x in folded for x in _lorem())


_SCRIPTS = re.compile(r"[A-Za-z\x80-ɏ�'’0-9]+|[Ѐ-ӿ]+|[؀-ۿ]+|[぀-ヿ一-鿿]+")
_JAPANESE = re.compile(r"[぀-ヿ一-鿿]")
_JOINED = re.compile(r"\b(log|sign|logged|signed)[ -]+in\b", re.I)
#: Addresses and paths in messages; they stand for themselves.
_PATH = re.compile(r"\w+://\S+|(?:[\w.-]*/)+[\w.-]+\b")
_STATUS = re.compile(r"(?<![\w.,:])[45][0-9OoIl]{2}(?![\w:])")
#: Faults as runtimes print them; fixed values of their formats.
_FAULT = re.compile(
    r"\b(?:fata[lI]|parse|uncaught|syntax|warning)\b.*\b[o0]n [lI1]in[ec] \d+|traceback \(most recent call last\)|\b(?:[a-z_$]\w*\.)+[A-Z]\w*(?:Exception|Error)\b|\buncaught \w*(?:error|exception)\b|\b(?:warning|notice|fata[lI] error): \w+\(", re.I
)


@lru_cache(1)
def _vocabulary() -> tuple[dict[str, frozenset], list[tuple[str, frozenset]], dict[str, frozenset], set[str], int]:
    """Words to concepts: folded Latin and whole foreign words; foreign stems; Japanese runs; speakers; longest run."""
    words: dict[str, set] = {}
    stems: dict[str, set] = {}
    runs: dict[str, set] = {}

    def add(word: str, concept: str | None) -> None:
        into = words
        if _JAPANESE.search(word):
            spellings, into = {word}, runs
        elif _OTHER_SCRIPT.search(word):
            spellings, into = {word.rstrip("*")}, stems if word.endswith("*") else words
        elif word.endswith("*"):
            spellings, into = {_quick(w) + "*" for w in (word, _unaccented(word))}, words
        else:
            spellings = {_quick(part) for w in (word, _unaccented(word)) for part in re.split("['’-]", w)}
        for s in spellings:
            if s:
                into.setdefault(s, set()).update([concept] if concept else [])

    for concept, text in messages.CONCEPTS.items():
        for w in text.split():
            add(w, concept)
    for w in messages.PLAIN.split():
        add(w, None)
    for phrase in messages.REASONS.split(";"):
        for w in phrase.split():
            add(w, None)
    frozen = lambda d: {k: frozenset(v) for k, v in d.items()}
    runs = frozen(runs)
    return frozen(words), sorted(frozen(stems).items(), key=lambda x: -len(x[0])), runs, set(messages.SPEAKERS.split()), max(map(len, runs))


def _unaccented(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))


def _foreign(token: str) -> frozenset | None:
    """The concepts of a Cyrillic or Arabic word, also behind an article or a conjunction."""
    words, stems, *_ = _vocabulary()
    for t in (token, token[1:], token[2:], token[3:]) if "؀" <= token[0] <= "ۿ" else (token,):
        if len(t) > 1 or t is token:
            known = words.get(t)
            stem = next((c for s, c in stems if t.startswith(s)), None)
            if known is not None or stem is not None:
                return (known or frozenset()) | (stem or frozenset())
    return None


def concepts_of(piece: str) -> tuple[set[str], float, float, bool]:
    """(concepts, words, words that no message has, whether somebody speaks) of a fragment."""
    words, _, runs, speakers, longest = _vocabulary()
    found: set[str] = set()
    n = strange = 0.0
    speaks = False
    piece = _JOINED.sub("login", _PATH.sub(" ", piece))
    for m in _SCRIPTS.finditer(piece):
        token = m.group().lower()
        if token.isdigit():
            continue
        if _JAPANESE.match(token):
            at = 0
            while at < len(token):
                for k in range(min(longest, len(token) - at), 0, -1):
                    hit = runs.get(token[at : at + k])
                    if hit is not None:
                        found |= hit
                        n += 1
                        at += k
                        break
                else:
                    strange += 0.0 if "ぁ" <= token[at] <= "ゟ" else 0.5
                    at, n = at + 1, n + 0.5
            continue
        if "Ѐ" <= token[0] <= "ӿ" or "؀" <= token[0] <= "ۿ":
            n += 1
            speaks |= token in speakers
            hit = _foreign(token)
            if hit is None:
                strange += 1
            else:
                found |= hit
            continue
        speaks |= token in speakers
        for part in re.split("['’]", token):
            folded = _quick(part)
            if not folded:
                continue
            n += 1
            hit = words.get(folded)
            for k in range(STEM, len(folded)) if hit is None else ():
                hit = hit or words.get(folded[:k] + "*")
            if hit is None and len(folded) > 1:
                strange += 1
            elif hit:
                found |= hit
    if "can't" in piece.lower() or "can’t" in piece.lower():
        found.add("not")
    return found, n, strange, speaks


@lru_cache(1)
def _rules() -> list[tuple[str, list[frozenset], bool]]:
    return [(kind, [frozenset(x.split("|")) for x in needs.split()], alone) for kind, needs, alone in messages.RULES]


@lru_cache(1)
def _reasons() -> set[str]:
    return {"".join(map(_quick, p.split())) for p in messages.REASONS.split(";")}


@lru_cache(8192)
def judge(piece: str) -> tuple[str, bool] | None:
    """(kind, certain) of the message that a fragment is as a whole; None if it is none. A message that is
    not certain is one only where the text holds nothing else."""
    if _FAULT.search(piece):
        return "error", True
    found, n, strange, speaks = concepts_of(piece)
    status = _STATUS.search(piece)
    if _is_lorem(_fold(piece)):
        return "filler", True
    if status and not n:
        return ("error", False) if _STATUS.fullmatch(piece.strip(" .:!-[]()")) else None
    if status and _fold(_PATH.sub(" ", _STATUS.sub(" ", piece))).removeprefix("http").removeprefix("error") in _reasons():
        return "error", True
    if _TODO.fullmatch(piece):
        return "filler", False
    if speaks or strange > n // STRANGE or not n:
        return None
    if status:
        found.add("#")
    best = None
    for kind, needs, alone in _rules():
        if (not alone or best is None) and all(found & need for need in needs):
            if not alone:
                return kind, True
            best = kind
    return (best, False) if best else None


@lru_cache(1)
def _variables() -> set[str]:
    return {_quick(v) for v in VARIABLES}


@lru_cache(1)
def _signs() -> re.Pattern:
    return re.compile("(?:" + "|".join(_quick(s) for s in SIGNS) + ")s?$")


def _placeholder(line: str) -> bool:
    for m in _PLACEHOLDER.finditer(line):
        before, after = line[: m.start()].rstrip(), line[m.end() :].lstrip()
        if before.endswith(",") and after.startswith(",") and _signs().search(_quick(before)):
            continue  # a speaker names its sign
        if m.group("single"):
            name = m.group("single")[1:-1]
            if not ("_" in name or "." in name or _quick(name) in _variables()):
                continue  # a sound or a style
        own = m.group("own")
        if own and not ("_" in own or "." in own or any(_quick(w) in _variables() for w in own.split()[-1:])):
            continue  # a remark
        return True
    return False


def _pieces(text: str) -> list[str]:
    cut = _CUT.sub("\n", text)
    if "&" not in cut:
        return cut.split("\n")
    return [html.unescape(p).replace("\n", " ") for p in cut.split("\n")]


#: Concepts of which one at least is in every message that counts beside other content.
_ANCHORS = "script cookies thing access error denied fails bad there human limit login redirect upkeep sample sample_text text line wrong".split()
_WORDS = bytes(b if chr(b).isalnum() and b < 128 or b == 10 else 32 for b in range(256))


@lru_cache(1)
def _anchors():
    """Finders of the anchors' words: in folded text with blanks between words, and in other scripts."""
    words, stems, runs, _, _ = _vocabulary()
    some = {a for a in _ANCHORS}
    latin = {f" {w.rstrip('*')}" + " " * (w[-1] != "*") for w, c in words.items() if c & some and w.isascii()} | {" log in ", " logged in ", " sign in ", " signed in ", " on iine ", " traeebaek ", " waming ", " notiee ", "exeeption ", "error "}
    latin |= {f" {max(map(_quick, phrase.split()), key=len)} " for phrase in messages.REASONS.split(";")}
    for run in _lorem_runs():
        latin |= {f" {_quick(a)} {_quick(b)} " for a, b in zip(run, run[1:], strict=False)} | {_quick(w) for w in run if len(w) > 6}
    other = {w for w, c in [*words.items(), *stems, *runs.items()] if c & some and not w.isascii()}
    return _finder(latin), _finder(other)


def _finder(words: set[str]):
    """A function of a text to the positions where any of the words ends."""
    try:
        import ahocorasick
    except ImportError:
        pattern = re.compile("(?=(" + "|".join(map(re.escape, sorted(words))) + "))")
        return lambda text: (m.end(1) - 1 for m in pattern.finditer(text))
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, True)
    automaton.make_automaton()
    return lambda text: (end for end, _ in automaton.iter(text))


def _suspects(lines: list[str]) -> list[int]:
    """Numbers of the lines that hold an anchor, found over all of them at once."""
    text = "\n".join(html.unescape(x).replace("\n", " ") if "&" in x else x for x in lines)
    latin, other = _anchors()
    raw = text.lower().encode("ascii", "ignore").translate(_WORDS).translate(_LATIN, b"234679")
    raw = b" ".join(raw.replace(b"rn", b"m").replace(b"vv", b"w").replace(b"\n", b" | ").split())
    found = _at(f" {raw.decode('ascii')} ", latin, "|")
    if not text.isascii() and _OTHER_SCRIPT.search(text):
        found |= _at(text.lower(), other)
    return sorted(found)


def _at(text: str, finder, end_of_line: str = "\n") -> set[int]:
    """Numbers of the lines in which words end."""
    out: set[int] = set()
    line = start = 0
    for end in finder(text):
        line += text.count(end_of_line, start, end)
        start = end
        out.add(line)
    return out


def _evidence(text: str, lines: list[str] | None = None) -> tuple[list[tuple[str, str, bool]], list[str]]:
    """(kind, line, certain) of the lines that hold evidence, and the lines of other content; `lines` are those of the text in
    its repaired encoding, if they are known."""
    found: dict[tuple[str, str], bool] = {}
    if _HINT.search(text):
        for line in text.splitlines():
            if _HINT.search(line) and _placeholder(line):
                found["placeholder", line] = True
    lines = _lines(text) if lines is None else lines
    suspects = _suspects(lines)
    if _few(lines):
        suspects = range(len(lines))
    used = set()
    if _STATUS.fullmatch(text.strip()):
        found["error", text] = True
    for k in suspects:
        if k in used or _FRAME.fullmatch(lines[k]):
            continue
        hits = [h for h in map(judge, _pieces(lines[k])) if h]
        whole = [k]
        if not any(certain for _, certain in hits):
            whole = _around(lines, k)
            joined = judge(" ".join(lines[j] for j in whole)) if len(whole) > 1 else None
            if joined and joined[1]:
                hits = [joined]
            else:
                whole = [k]
        for kind, certain in hits:
            found[kind, lines[k]] = certain or found.get((kind, lines[k]), False)
            used.update(whole)
    if not found:
        return [], []
    marked = {line for _, line in found}
    return [(*e, c) for e, c in found.items()], [x for j, x in enumerate(lines) if j not in used and x not in marked and not _FRAME.fullmatch(x)]


def _lines(text: str) -> list[str]:
    return (text if text.isascii() else repair(text)).splitlines()


_LETTER = re.compile(r"[^\W\d_]")


def normal_lines(lines: list[str]) -> set[str]:
    """The distinct lines of content of a text, with case, digits and blanks at the ends made equal."""
    text = "\n".join(lines).lower().encode("utf-8", "replace").translate(None, b"0123456789").decode("utf-8")
    return {x for x in map(str.strip, set(text.split("\n"))) if _LETTER.search(x)}


def line_hashes(normal: list[str]):
    """64-bit hashes of normalised lines, the same in every process."""
    import numpy as np
    from pandas.util import hash_array

    return hash_array(np.array([*normal, ""], dtype=object), categorize=False)[:-1].view(np.int64)


def _few(lines: list[str]) -> bool:
    n = 0
    for line in lines:
        n += not _FRAME.fullmatch(line)
        if n > LONE:
            return False
    return True


def _around(lines: list[str], k: int) -> list[int]:
    """The lines of one cue: those next to line k without a blank line or a frame between, three at most on each side."""
    first = last = k
    while first > 0 and k - first < 3 and not _FRAME.fullmatch(lines[first - 1]):
        first -= 1
    while last + 1 < len(lines) and last - k < 3 and not _FRAME.fullmatch(lines[last + 1]):
        last += 1
    return list(range(first, last + 1))


def evidence(text: str) -> list[tuple[str, str]]:
    """(kind, line) of the evidence in a text by itself, without a host to compare it with."""
    found, others = _evidence(text)
    return [(kind, line) for kind, line, certain in found if certain or not others]


#: Rows of kind `count` say how many of a batch's rows of a host hold a line beside other content; the others are evidence.
_SCHEMA = "doc_id bigint, host string, kind string, line bigint, n bigint, certain boolean, beside boolean, others array<bigint>"


def _scan(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    names = ["doc_id", "host", "kind", "line", "n", "certain", "beside", "others"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.int64())]
    for batch in batches:
        counted: dict[str, list] = {}
        for at in range(0, batch.num_rows, 1000):
            rows, some = [], batch.slice(at, 1000)
            content: dict[str, list[str]] = {}
            for i, host, text in zip(*(some.column(c).to_pylist() for c in ("doc_id", "host", "text")), strict=True):
                if not text:
                    continue
                lines = _lines(text)
                normal = normal_lines(lines)
                if len(normal) > 1:
                    content.setdefault(host, []).extend(normal)
                found, others = _evidence(text, lines)
                if found:
                    beside = bool(others) or len({line for _, line, _ in found}) > 1
                    own = line_hashes([next(iter(normal_lines([line])), "") for _, line, _ in found]).tolist()
                    rest = [] if all(c for *_, c in found) else line_hashes(sorted(normal_lines(others))).tolist()
                    rows += [(i, host, kind, h, None, certain, beside, [] if certain else rest) for (kind, _, certain), h in zip(found, own, strict=True)]
            for host, normal in content.items():
                counted.setdefault(host, []).append(line_hashes(normal))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        for host, parts in counted.items():
            lines, n = np.unique(np.concatenate(parts), return_counts=True)
            none = [pa.nulls(len(lines), k) for k in kinds]
            none[1], none[2], none[3], none[4] = pa.array([host] * len(lines), pa.string()), pa.array(["count"] * len(lines), pa.string()), pa.array(lines), pa.array(n.astype(np.int64))
            yield pa.RecordBatch.from_arrays(none, names)


def scanned(texts: DataFrame) -> DataFrame:
    """Evidence and counts of lines of (doc_id, host, text), in one look at each text."""
    return spread(texts).mapInArrow(_scan, _SCHEMA)


def line_counts(found: DataFrame) -> DataFrame:
    """(host, line, n): how many of a host's rows hold a normalised line (its hash) beside other content.

    All lines are counted, once a row; lines without a letter are no content.
    """
    return found.where("kind = 'count'").groupBy("host", "line").agg(F.sum("n").alias("n"))


def boilerplate(found: DataFrame, texts: DataFrame, recurrent: float = RECURRENT) -> DataFrame:
    """(host, line): the hashes of the lines in more than `recurrent` of a host's rows, MIN_DOCUMENTS at least."""
    sizes = texts.groupBy("host").agg(F.count("*").alias("rows"))
    often = line_counts(found).where(F.col("n") >= MIN_DOCUMENTS)
    return often.join(sizes, "host").where(F.col("n") > recurrent * F.col("rows")).select("host", "line")


def residue(documents: DataFrame, recurrent: float = RECURRENT) -> DataFrame:
    """(doc_id, kind): the kinds of evidence in each document that has any, once each.

    Null, empty and blank texts have none. A document given twice is reported once and is one document
    of its host; columns other than doc_id, source and text are ignored; a null source is a host of its own.
    """
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("host"), F.col("text").cast("string").alias("text"))
    texts = texts.where("text is not null and text <> ''")
    found = materialise(scanned(texts), "lines")  # texts are read once
    often = materialise(boilerplate(found, texts, recurrent), "boilerplate")
    key = ["host", "line"]
    marked = found.where("kind <> 'count'").drop("n")
    # rows were counted; a line is subtracted only if it recurs by documents too, and never where it is the whole text
    suspect = marked.where("beside").join(checked_broadcast(often), key, "left_semi").select("doc_id", *key).distinct().groupBy(*key).agg(F.count("*").alias("n"))
    sizes = texts.select("doc_id", "host").join(checked_broadcast(often.select("host").distinct()), "host", "left_semi").distinct().groupBy("host").agg(F.count("*").alias("documents"))
    gone = suspect.join(sizes, "host").where((F.col("n") >= MIN_DOCUMENTS) & (F.col("n") > recurrent * F.col("documents"))).select(*key)
    left = marked.where("beside").join(gone, key, "left_anti").unionByName(marked.where("not beside"))
    unsure = left.where("not certain")
    rest = unsure.select("doc_id", "host", F.explode("others").alias("line"))
    spoken = rest.join(checked_broadcast(often), key, "left_anti").select("doc_id").distinct()
    alone = unsure.join(spoken, "doc_id", "left_anti")
    return left.where("certain").select("doc_id", "kind").unionByName(alone.select("doc_id", "kind")).distinct()


def clean_corpus(documents: DataFrame) -> DataFrame:
    """The documents without evidence, all columns as they were."""
    return documents.join(residue(documents).select("doc_id").distinct(), "doc_id", "left_anti")

"""Linear-chain conditional random field over word-shape features, in numpy.

A token's score for a label is a sum of weights: of the features of the tokens around it (each by its distance), of the blank before
it, of the shapes and word classes of three neighbours together, of the run of non-blank characters and the chunk of numbers it stands
in, and of how far back a word announces a number, an address or a name. Features depend on a token, run or chunk alone, so each
distinct one is scored once for every place and texts are scored by gathering rows. Tokens, runs, chunks and paragraphs count whole,
whatever their length.

Training maximises the regularised likelihood (forward-backward over padded batches, AdaGrad); features that are rare in the labelled
table get no weight, so that its names are not learnt by heart. Decoding is Viterbi over padded batches.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterable, Sequence

import numpy as np

#: A token is a code of capitals and digits, a run of digits, of ideographs or kana, of other letters (with apostrophes), or one sign.
_LETTER, _MARK = r"[^\W\d_\u3040-\u30ff\u3400-\u9fff]", r"[\u0300-\u036f]"
TOKEN = re.compile(rf"(?<![A-Za-z0-9])(?=[A-Z]*[0-9])(?=[0-9]*[A-Z])[A-Z0-9]{{6,12}}(?![A-Za-z0-9])|{_LETTER}+(?:{_MARK}+{_LETTER}*|[’']{_LETTER}+)*|\d+|[\u3040-\u30ff\u3400-\u9fff]+|[^\w\s]|_")
#: Distances of the tokens whose features count, and the size of the weight table (features are placed by hash).
REACH, TABLE = 3, 1 << 19
#: A feature that the labelled table has less often gets no weight.
LEAST_SEEN = 4
#: Strings whose classes are kept in a process; beyond, they are collected anew. They save time and change no result.
MOST_KNOWN = 600_000
#: Signs that part the words of a long run without a blank, beside kana, ideographs and wide forms.
_BORDER_SIGNS = np.array([ord(c) for c in ',;<>"“”|'], dtype=np.uint32)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
#: Numbers with the signs and single blanks that join them.
CHUNK = re.compile(r"[+(]*\d+(?:[ \u00a0.\-–/()]{1,2}\d+)*")

#: Word classes of everyday language that tell what a word is, whatever the text is about.
CLASSES = {
    "title": "mr mrs ms miss dr prof professor sir madam judge captain nurse officer herr frau monsieur madame mme mlle señor señora sr sra don doña signor signora",
    "street": "street st avenue ave road rd lane ln drive dr boulevard blvd court ct place square terrace way close crescent gardens parkway row walk grove quay mews rise hill highway rue allée impasse quai chemin calle avenida av plaza paseo camino carrer ronda via viale piazza rua straße strasse str weg platz gasse damm ufer chaussee laan straat gracht plein postfach apartado",
    "unit": "apt apartment unit suite ste flat room floor piso planta bis ter etage stock building",
    "phone": "phone tel telephone telefon téléphone teléfono mobile cell fax call dial text ring handy rückruf appelez llame number ext extension whatsapp hotline reach",
    "identity": "ssn social security nino insurance tax tin passport reisepass pass passeport pasaporte dni nie nif id identity identification steuer steuernummer personalausweis identité pesel bsn cpf ahv nir national idnr versichertennummer sozialversicherungsnummer fiscal",
    "mail": "mail e-mail email mailto mailbox courriel correo write cc bcc subscribe reply",
    "address": "address adresse anschrift dirección lives live lived habite réside vive wohnt wohnhaft moved located residence resident deliver ship visit office house parcel",
    "person": "name nombre nom contact signed by dear hello hi hey regards sincerely cheers thanks liebe lieber cher chère querido estimada from with for owner author attn guest tenant patient colleague sister brother neighbour teacher lawyer called said wrote",
    "place": "in at near to of north south east west lake mount port town city city's nach bei aus à en hasta desde vers",
    "month": "january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember monday tuesday wednesday thursday friday saturday sunday",
    "particle": "van von der den de la le du des di da del della dos el al bin ben mc mac st o y",
    "verbal": "at dot",
    "thing": "order ticket invoice serial batch part case booking tracking article code key version build page chapter section rack port line isbn file path digest hash checksum commit size total sum between",
}
_CLASS_OF = {w: c for c, words in reversed(CLASSES.items()) for w in words.split()}
#: Classes whose distance back counts.
_ANNOUNCE = ("phone", "identity", "mail", "address", "person", "street", "title", "thing")
_KINDS = ["other", "Capital", "given", "family", "both", "small given", "initial", ".", ",", "number", "sign", "CAPITALS", "@", "code", "(", "-", *CLASSES]


def shape(token: str) -> str:
    """The shape of a token: capitals, small letters, digits and others, runs of more than three shortened; digits keep their number."""
    if token.isdigit():
        return f"d{len(token)}"
    out = "".join("X" if c.isupper() else "x" if c.isalpha() else "d" if c.isdigit() else c for c in token)
    return re.sub(r"(.)\1{2,}", r"\1\1\1", out)


def coarse(token: str) -> int:
    """A number below 20 for the kind of shape."""
    if token.isdigit():
        return min(len(token), 6)
    if token.isalpha() or "’" in token or "'" in token:
        return 7 if token.isupper() and len(token) > 1 else 8 if len(token) == 1 and token.isupper() else 9 if token[0].isupper() else 10
    if any(c.isdigit() for c in token):
        return 11
    return {",": 12, ".": 13, "@": 14, "(": 15, ")": 15, "-": 16, "/": 17, ":": 18}.get(token, 19)


def _is_border(chars: np.ndarray) -> np.ndarray:
    wide = ((chars >= 0x3000) & (chars <= 0x30FF)) | ((chars >= 0x3400) & (chars <= 0x9FFF)) | ((chars >= 0xFF00) & (chars <= 0xFFEF))
    return wide | np.isin(chars, _BORDER_SIGNS)


class _Classes:
    """Numbers of strings by what features they have, with the hashes of the features one after the other; kept between batches."""

    def __init__(self, features):
        self.features, self.known, self.by_features = features, {}, {}
        self.flat: list[int] = []
        self.kind: list[tuple[int, int, int]] = []
        self.begin: list[int] = []
        self.number_of("")

    def number_of(self, text: str) -> int:
        kind, names = self.features(text) if text else ((0, 0, 0), ["none"])
        key = (kind, *names)
        n = self.by_features.get(key)
        if n is None:
            n = self.by_features[key] = len(self.begin)
            self.begin.append(len(self.flat))
            self.flat += [zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in names]
            self.kind.append(kind)
        self.known[text] = n
        return n

    def numbers(self, texts: Sequence[str]) -> np.ndarray:
        known, new = self.known.get, self.number_of
        return np.array([k if (k := known(t)) is not None else new(t) for t in texts], dtype=np.int32)


def plain_word(word: str) -> str:
    """The form in which words are compared with lists."""
    return unicodedata.normalize("NFC", word.casefold())


def family_words(name: str) -> set[str]:
    """The words of a family name that tell it: all that are longer than three letters, and the name itself."""
    f = plain_word(name)
    return {part for part in re.split(r"[ -]", f) if len(part) > 3} | {f}


class Features:
    """Features of tokens, runs and chunks, with lists of listed given and family names."""

    def __init__(self, given: Iterable[str] = (), family: Iterable[str] = ()):
        self.given = {plain_word(part) for g in given for part in (g, *g.split("-"))}
        self.family = {w for f in family for w in family_words(f)}
        self.tables: dict[int, np.ndarray] = {}
        self.weights: np.ndarray | None = None
        self.restart()

    def restart(self) -> None:
        """Forgets the strings seen so far."""
        self.tokens, self.runs, self.chunks = _Classes(self.of_token), _Classes(self.of_run), _Classes(self.of_chunk)
        self.tables.clear()

    def of_token(self, token: str) -> tuple[tuple[int, int, int], list[str]]:
        """((coarse shape, kind of word, class that announces), features)."""
        w = plain_word(token)
        rough = coarse(token)
        if rough <= 6 or rough == 11:  # numbers and codes: only their shape tells
            return (rough, _KINDS.index("number" if rough <= 6 else "code"), 0), ["b", f"n={min(len(w), 12)}", f"s={shape(token)}", f"c={rough}"]
        g, f, cls = w in self.given, w in self.family, _CLASS_OF.get(w)
        out = ["b", f"w={w}", f"s={shape(token)}", f"c={rough}"]
        if rough in (7, 8, 9, 10):
            out.append(f"len={min(len(w), 12)}")
            if len(w) > 4:
                out += [f"e={w[-3:]}", f"e={w[-2:]}"]
        if cls:
            out += [f"L={cls}", f"L={cls}{rough}"]
        if g:
            out += ["given", f"given{rough}"]
        if f:
            out += ["family", f"family{rough}"]
        if g and cls:
            out.append(f"given{cls}")
        capital = rough in (7, 9)
        if g or f:
            kind = ("both" if g and f else "given" if g else "family") if capital else "small given"
        elif cls and not (capital and cls in ("particle", "place") and len(w) > 3):
            kind = cls
        else:
            kind = {7: "CAPITALS", 8: "initial", 9: "Capital", 10: "other", 12: ",", 13: ".", 14: "@", 15: "(", 16: "-"}.get(rough, "sign")
        return (rough, _KINDS.index(kind), 1 + _ANNOUNCE.index(cls) if cls in _ANNOUNCE else 0), out

    @staticmethod
    def of_run(run: str) -> tuple[tuple[int, int, int], list[str]]:
        core = run.strip("()<>[]{},;:.“”\"'")
        kind = []
        if "@" in core:
            kind.append("at-in" if re.fullmatch(r"[^@\s]+@[^@\s]+\.[^@\s]+", core.removeprefix("mailto:")) else "at-start" if core.startswith("@") else "at-end" if core.endswith("@") else "at-bare")
        if re.search(r"[\[({](at|dot)[\])}]", run.casefold()):
            kind.append("at-word")
        if re.fullmatch(r"[\w-]+(\.[\w-]+)*\.[a-z]{2,}", core):
            kind.append("host")
        digits = sum(c.isdigit() for c in core)
        kind.append(f"digits{min(digits, 20)}" if digits else "letters" if core.isalpha() else "signs")
        if digits and not any(c.isalpha() for c in core):
            kind.append("form=" + re.sub(r"\d+", lambda m: f"d{min(len(m.group()), 9)}", core))
        if "/" in core and not digits:
            kind.append("path")
        if "/" in core and "." in core and any(c.isalpha() for c in core):
            kind.append("file")
        if len(core) > 24:
            kind.append("long")
        elif digits and core.isalnum() and core.isupper():
            kind += [f"code{len(core)}", "code=" + re.sub(r"[A-Z]", "X", re.sub(r"\d", "0", core))]
        elif digits and core.isalnum() and not core.isdigit():
            kind.append("mixed-code")
        if re.search(r"straße|strasse|weg|allee|platz|gasse|damm|ufer|straat|laan|gracht|vägen|gatan", core.casefold()):
            kind.append("street-end")
        kind.append("w=" + core.casefold() if core.isalpha() else "mixed")
        return (0, 0, 0), kind

    @staticmethod
    def of_chunk(chunk: str) -> tuple[tuple[int, int, int], list[str]]:
        groups = re.findall(r"\d+", chunk)
        digits = sum(map(len, groups))
        lead = "+" if chunk[0] == "+" else "(" if chunk[0] == "(" else "00" if chunk.startswith("00") else "0" if chunk[0] == "0" else "1"
        signs = "".join(sorted(set(re.sub(r"[\d+]", "", chunk))))
        form = re.sub(r"\d+", lambda m: f"d{min(len(m.group()), 12)}", chunk)
        return (0, 0, 0), [f"form={form}", f"digits={min(digits, 24)}", f"groups={min(len(groups), 8)}", f"both={min(digits, 24)},{min(len(groups), 8)}", f"lead={lead}", f"lead={lead},{min(digits, 16)}", f"signs={signs}", f"sizes={','.join(str(min(len(g), 9)) for g in groups)}"]


class Encoded:
    """Texts cut into sequences of tokens (paragraphs), with the classes of their tokens, runs and chunks."""

    def __init__(self, texts: Sequence[str], features: Features):
        if len(features.tokens.known) + len(features.runs.known) + len(features.chunks.known) > MOST_KNOWN:
            features.restart()
        offsets = np.cumsum([0, *(len(t) + 2 for t in texts)], dtype=np.int64)
        text = "\n\n".join(texts)  # a blank line parts texts as it parts paragraphs, so all are gone through at once
        found = [m.span() for m in TOKEN.finditer(text)]
        n = len(found)
        s, e = np.array(found, dtype=np.int64).reshape(-1, 2).T
        words = [text[a:b] for a, b in found]
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        between = s - np.append(0, e[:-1]) if n else s
        sign = chars[np.maximum(s - 1, 0)]
        self.gap = np.where(between == 0, 0, np.where(between == 1, np.where(sign == 32, 1, np.where((sign == 10) | (sign == 13), 3, 2)), 2)).astype(np.int32)
        opens = np.zeros(n, dtype=bool)
        opens[:1] = True
        for i in np.nonzero(between > 1)[0].tolist():
            blank = text[e[i - 1] if i else 0 : s[i]]
            if "\n" in blank or "\r" in blank:
                self.gap[i] = 3
                opens[i] |= bool(_PARAGRAPH.search(blank))
        self.gap[opens] = 3
        border = _is_border(chars[s])
        self.fresh = (between > 0) | opens | border | np.append(False, border)[:n]
        number = np.cumsum(self.fresh) - 1
        at = np.nonzero(self.fresh)[0]
        last = e[np.append(at[1:] - 1, n - 1)[: len(at)]]
        self.run = features.runs.numbers([text[x:y] for x, y in zip(s[at].tolist(), last.tolist())])[number]
        self.place = np.minimum(np.arange(n) - at[number], 3).astype(np.int32)
        self.chunk, self.spot = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
        spans = [m.span() for m in CHUNK.finditer(text)]
        if spans and n:
            of = features.chunks.numbers([text[x:y] for x, y in spans])
            low, high = np.array(spans, dtype=np.int64).T
            which = np.searchsorted(low, s, side="right") - 1
            inside = (which >= 0) & (s < high[np.maximum(which, 0)])
            self.chunk[inside] = of[which[inside]]
            order = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, which[1:] != which[:-1]), np.arange(n), 0))
            self.spot[inside] = np.minimum(order[inside], 2)
        self.token = features.tokens.numbers(words)
        self.text_of = np.searchsorted(offsets, s, side="right") - 1
        self.start, self.end = s - offsets[self.text_of], e - offsets[self.text_of]
        self.first = np.append(np.nonzero(opens)[0], n).astype(np.int64)
        self.sequence = np.cumsum(opens) - 1

    def neighbours(self, distance: int, of: np.ndarray) -> np.ndarray:
        """of shifted by distance within each sequence; 0 beyond its ends."""
        if distance == 0:
            return of
        out, n = np.zeros_like(of), len(of)
        if abs(distance) < n:
            here, there = (slice(0, n - distance), slice(distance, n)) if distance > 0 else (slice(-distance, n), slice(0, n + distance))
            out[here] = np.where(self.sequence[here] == self.sequence[there], of[there], 0)
        return out

    def since(self, marked: np.ndarray) -> np.ndarray:
        """How far back the last marked token of the sequence is: 1 next, 2 up to three, 3 up to six, 4 up to twelve tokens, else 0."""
        n = len(marked)
        at = np.arange(n)
        before = np.append(-1, np.maximum.accumulate(np.where(marked, at, -1))[:-1]) if n else at
        far = np.where(before >= self.first[self.sequence] if n else False, at - before, 1 << 30)
        return np.where(far > 12, 0, np.searchsorted(np.array([1, 3, 6, 12]), far, side="left") + 1)


def _placed(base: np.ndarray, template: int) -> np.ndarray:
    """The weight rows of feature hashes in a template."""
    return (((base.astype(np.uint64) * np.uint64((2 * template + 1) * 2654435761) + np.uint64(template * 97531)) >> np.uint64(9)) % np.uint64(TABLE)).astype(np.int64)


def _own(size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """One feature for each of size classes."""
    return np.arange(size), np.arange(1, size + 1, dtype=np.uint64) * np.uint64(104729 + 2 * salt)


def templates(e: Encoded, f: Features) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(class of each token, first feature of each class, hashes of the features) per template, in a fixed order."""
    tokens, runs, chunks = ((np.array(x.begin), np.array(x.flat, dtype=np.uint64)) for x in (f.tokens, f.runs, f.chunks))
    out = [(e.neighbours(d, e.token), *tokens) for d in range(-REACH, REACH + 1)]
    out += [(np.where(e.place == p, e.run, 0), *runs) for p in range(4)]
    out += [(_next_run(e, d), *runs) for d in (-1, 1, -2, 2)]
    out += [(np.where(e.spot == p, e.chunk, 0), *chunks) for p in range(3)]
    out += [(e.neighbours(d, e.chunk), *chunks) for d in (-2, 2)]
    after = np.where(e.neighbours(1, np.ones(len(e.gap), dtype=np.int32)) == 0, 4, e.neighbours(1, e.gap))
    pairs = np.array([[a * 5 + b + 1000, a + 2000, b + 3000] for a in range(4) for b in range(5)], dtype=np.uint64) * np.uint64(7919)
    out.append((e.gap.astype(np.int64) * 5 + after, np.arange(0, 60, 3), pairs.ravel()))
    kinds = np.array(f.tokens.kind, dtype=np.int64)[e.token].reshape(-1, 3)
    rough, kind, announces = kinds[:, 0], kinds[:, 1] + 1, kinds[:, 2]
    m = len(_KINDS) + 1
    for trio in ((-1, 0, 1), (0, 1, 2), (-2, -1, 0)):
        x, y, z = (e.neighbours(k, rough) for k in trio)
        out.append(((x * 20 + y) * 20 + z, *_own(8000, 1)))
        x, y, z = (e.neighbours(k, kind) for k in trio)
        out.append(((x * m + y) * m + z, *_own(m**3, 2)))
    for c in range(1, len(_ANNOUNCE) + 1):
        back = e.since(announces == c)
        out.append((back * m + kind, *_own(5 * m, 3)))
        out.append((back * 20 + rough, *_own(100, 4)))
    return out


def _next_run(e: Encoded, steps: int) -> np.ndarray:
    """The run so many runs away from each token's own, 0 beyond the sequence."""
    if not len(e.run):
        return e.run
    number = np.cumsum(e.fresh) - 1
    run, of = e.run[e.fresh], e.sequence[e.fresh]
    target = np.arange(len(run)) + steps
    inner = np.clip(target, 0, len(run) - 1)
    return np.where((target == inner) & (of[inner] == of), run[inner], 0).astype(e.run.dtype)[number]


def scores(e: Encoded, f: Features, weights: np.ndarray) -> np.ndarray:
    """The score of each token for each label. Classes seen before keep their scores; f belongs to one table of weights."""
    if f.weights is not weights:
        f.tables.clear()
        f.weights = weights
    out = np.zeros((len(e.token), weights.shape[1]), dtype=np.float32)
    for t, (number, begin, flat) in enumerate(templates(e, f)):
        table = f.tables.get(t)
        done = 0 if table is None else len(table)
        if done < len(begin):
            more = np.add.reduceat(weights[_placed(flat[begin[done] :], t)], begin[done:] - begin[done], axis=0)
            table = f.tables[t] = more if table is None else np.concatenate([table, more])
        out += table[number]
    return out


def batches(first: np.ndarray, size: int = 60_000) -> Iterable[np.ndarray]:
    """Numbers of sequences of similar length, padded to size tokens or so."""
    order = np.argsort(np.diff(first), kind="stable")
    begin = 0
    lengths = np.diff(first)[order]
    for k in range(len(order)):
        if k + 1 == len(order) or lengths[k + 1] * (k + 2 - begin) > size:
            yield order[begin : k + 1]
            begin = k + 1


def viterbi(score: np.ndarray, first: np.ndarray, step: np.ndarray, opening: np.ndarray) -> np.ndarray:
    """The best labels of each token, sequences decoded side by side."""
    best = np.zeros(len(score), dtype=np.int8)
    from_any = np.ascontiguousarray(step.T)[None]
    for group in batches(first):
        begin, length = first[group], first[group + 1] - first[group]
        width = int(length.max())
        at = score[begin] + opening
        back = np.zeros((width, len(group), score.shape[1]), dtype=np.int8)
        ends = np.zeros((len(group), score.shape[1]), dtype=np.float32)
        ends[length == 1] = at[length == 1]
        for t in range(1, width):
            live = int(np.searchsorted(length, t, side="right"))  # sequences are ordered by length
            joint = at[live:, None, :] + from_any
            back[t, live:] = joint.argmax(axis=2)
            at[live:] = joint.max(axis=2) + score[begin[live:] + t]
            done = length == t + 1
            ends[done] = at[done]
        label = ends.argmax(axis=1)
        for t in range(width - 1, -1, -1):
            live = int(np.searchsorted(length, t, side="right"))
            best[begin[live:] + t] = label[live:]
            if t:
                label[live:] = back[t, live:][np.arange(len(group) - live), label[live:]]
    return best


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def _expected(score: np.ndarray, first: np.ndarray, step: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The expected labels of each token, label pairs and opening labels, by forward-backward."""
    out, pairs, opens = np.zeros_like(score), np.zeros_like(step), np.zeros_like(opening)
    for group in batches(first):
        begin, length = first[group], first[group + 1] - first[group]
        width = int(length.max())
        pos = begin[:, None] + np.minimum(np.arange(width), length[:, None] - 1)
        x, live = score[pos], np.arange(width) < length[:, None]
        alpha = np.zeros_like(x)
        alpha[:, 0] = x[:, 0] + opening
        for t in range(1, width):
            alpha[:, t] = np.where(live[:, t, None], _logsum(alpha[:, t - 1, :, None] + step, 1) + x[:, t], alpha[:, t - 1])
        beta = np.zeros_like(x)
        for t in range(width - 2, -1, -1):
            beta[:, t] = np.where(live[:, t + 1, None], _logsum(step + (x[:, t + 1] + beta[:, t + 1])[:, None, :], 2), 0)
        z = _logsum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None])
        out[pos[live]] = p[live]
        for t in range(1, width):
            on = live[:, t]
            pairs += np.exp(alpha[on, t - 1, :, None] + step + (x[on, t] + beta[on, t])[:, None, :] - z[on, None, None]).sum(axis=0)
        opens += p[:, 0].sum(axis=0)
    return out, pairs, opens


def train(e: Encoded, f: Features, gold: np.ndarray, labels: int, rounds: int = 14, rate: float = 0.25, decay: float = 2e-5, least: int = LEAST_SEEN, part: int = 8_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, label-to-label scores and opening scores that fit gold, the label of each token; part tokens or so a step."""
    token_row, weight_row = [], []
    for t, (number, begin, flat) in enumerate(templates(e, f)):
        count = np.diff(np.append(begin, len(flat)))[number]
        token_row.append(np.repeat(np.arange(len(number), dtype=np.int32), count))
        within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        weight_row.append(_placed(flat, t)[np.repeat(begin[number], count) + within].astype(np.int32))
    token_row, weight_row = np.concatenate(token_row), np.concatenate(weight_row)
    often = np.bincount(weight_row, minlength=TABLE)
    keep = often[weight_row] >= least
    token_row, weight_row = token_row[keep], weight_row[keep]
    places, weight_row = np.unique(weight_row, return_inverse=True)  # only these rows of the table are trained
    weight_row = weight_row.astype(np.int32)
    order = np.argsort(token_row, kind="stable")
    token_row, weight_row = token_row[order], weight_row[order]
    token_cut = np.searchsorted(token_row, np.arange(len(e.token) + 1))
    bounds, since = [0], 0
    for k in range(1, len(e.first)):
        if e.first[k] - e.first[since] >= part or k == len(e.first) - 1:
            bounds.append(k)
            since = k
    parts = []
    for a, b in zip(bounds, bounds[1:]):
        lo, hi = e.first[a], e.first[b]
        rows = weight_row[token_cut[lo] : token_cut[hi]]
        by_weight = np.argsort(rows, kind="stable")
        used, cut = np.unique(rows[by_weight], return_index=True)
        parts.append((lo, hi, e.first[a : b + 1] - lo, rows, token_cut[lo:hi] - token_cut[lo], token_row[token_cut[lo] : token_cut[hi]][by_weight] - lo, used, cut))
    w, step, opening = np.zeros((len(places), labels)), np.zeros((labels, labels)), np.zeros(labels)
    seen_w, seen_step, seen_open = np.full_like(w, 1e-6), np.full_like(step, 1e-6), np.full_like(opening, 1e-6)
    one, g = np.eye(labels), np.random.default_rng(1)
    for _ in range(rounds):
        for k in g.permutation(len(parts)):
            lo, hi, first, rows, cut_t, tokens, used, cut = parts[k]
            y = gold[lo:hi]
            expected, pairs, opens = _expected(np.add.reduceat(w[rows], cut_t, axis=0), first, step, opening)
            inner = np.ones(hi - lo, dtype=bool)
            inner[first[:-1]] = False
            d_step, d_open = -pairs, -opens
            np.add.at(d_step, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            np.add.at(d_open, y[first[:-1]], 1)
            n = len(first) - 1
            d_w = np.add.reduceat((one[y] - expected)[tokens], cut, axis=0) / n - decay * w[used]
            seen_w[used] += d_w * d_w
            w[used] += rate * d_w / np.sqrt(seen_w[used])
            for x, d, seen in ((step, d_step / n - decay * step, seen_step), (opening, d_open / n - decay * opening, seen_open)):
                seen += d * d
                x += rate * d / np.sqrt(seen)
    table = np.zeros((TABLE, labels), dtype=np.float32)
    table[places] = w
    return table, step.astype(np.float32), opening.astype(np.float32)

"""Personal data by a skip-chain conditional random field.

Runs of non-blanks are split into tokens at brackets, quotes, colons, commas, equals signs and
the like, and around an address that stands within a longer token.  Nodes with labels are

* tokens with an ASCII digit or '@';
* tokens that something introduces: a credential's name ("password: ..."), a title or "name:",
  the form of a vendor's key or of an IBAN;
* and every other token of the document that is the same as one that was introduced.

The other tokens are observed as background: outside every entity, and they cut the
chain.  A number in groups is several nodes.  Potentials:

* node: weights on the token's shape, what introduces it, its neighbours and the number
  whose group it may be;
* chain: a weight for each pair of labels of adjacent nodes;
* skip: between a node and the next one in the same document with the same core
  (the token without outer punctuation; the whole number of a grouped one), however far away,
  or the next with the same shape and the same eight leading characters; it rewards equal labels.

A name or password is introduced once and repeated bare; the bare token alone tells nothing, and
only the skip edges label it.  Loopy sum-product message passing over the whole document
gives the marginals; a node takes the label with the largest one.  All weights are fitted
together, by maximum pseudo-likelihood, on text that is generated here.
"""

from __future__ import annotations

import ipaddress
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

LABELS = ("O", "EMAIL", "PHONE", "CARD", "IP", "SECRET", "NAME", "ID")
SCHEMA = "doc_id bigint, start_char bigint, end_char bigint, label string, probability double"
#: So many rounds of messages go undamped.
ROUNDS = 30
_RUN = re.compile(r"\S+")
_NODE = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
_EDGE = "\"'`.,;:!?*#$%&|<>[]{}=_~^/\\-"
_EMAIL = re.compile(r"[A-Za-z0-9À-ɏ][\w.+%-]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_HEX = re.compile(r"[0-9a-fA-F]{24,}")
_OPAQUE = re.compile(r"(?=\S*\d)(?=\S*[A-Za-z])[A-Za-z0-9_+/-]{24,}={0,2}")
_KEYWORDS = {"token", "secret", "key", "password", "passwd", "apikey", "api_key", "auth", "credential", "bearer"}
_CALL = {"phone", "tel", "telephone", "mobile", "cell", "call", "fax", "telefon", "tél", "ring", "dial", "teléfono", "handy"}
_DELIMITERS = r"\s,;:=\"'`<>()\[\]{}|?!&#*$\\"
#: The area code keeps its brackets, and base64 its slashes.
_PIECE = re.compile(rf"\(\d{{2,5}}\)|[^{_DELIMITERS}]+")
_WORD = re.compile(rf"[^{_DELIMITERS}/]+")
_WITHIN = re.compile(rf"{_EMAIL.pattern}|(?<![\w.]){_IP.pattern}(?![\w]|\.\d)")
_IP6 = re.compile(r"(?<![\w:])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_SSN = re.compile(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)")
_IBAN_HINT = re.compile(r"[A-Z][A-Z][0-9][0-9]")
_VENDOR = re.compile(r"(?<!\w)(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{20,}|sk-[\w-]{20,}|xox[abprs]-[\w-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]+)(?!\w)")
_CREDENTIAL = re.compile(
    r"(?i)(?<![^\W_])(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[ _-]?key|access[ _-]?key|credentials?|passwort|kennwort|contraseña|mot de passe)"
    r"[\"']?(?:\s*[:=]\s*|\s+is\s+(?=[\"']?\S*\d))[\"']?([^\s\"'<>,;()]+)"
)
_PERSON = re.compile(
    r"(?<!\w)(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Sra?|Mme|Madame|Monsieur|Signora?)\b\.?\s+|(?:[Nn]ame|NAME) ?[:=]\s*|[Mm]y name is\s+)"
    r"([A-ZÀ-Þ][\w'’-]+(?:[ \t]+[A-ZÀ-Þ][\w'’-]+){0,2})"
)
#: What has to be in a text (in small letters) for these to be looked for.
_CREDENTIAL_HINTS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "key", "credential", "passwort", "kennwort", "contraseña", "mot de passe")
_PERSON_HINTS = ("Mr", "Ms", "Miss ", "Dr", "Prof", "Herr ", "Frau ", "Señor", "Sr", "Mme", "Madame ", "Monsieur ", "Signor", "ame:", "ame :", "ame=", "ame =", "AME:", "AME :", "AME=", "AME =", "y name is")
_VENDOR_HINTS = ("AKIA", "gh", "sk-", "xox", "eyJ")
#: Values that stand where a password could and are none.
_PLAIN = frozenset("required optional none null true false string yes no empty here reset invalid expired changed wrong unknown missing new old value text type int the a your".split())
_LIST = set(",;|/")  # between two numbers
#: How many digits the groups of a card number have.
_CARD_GROUPS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 3, 3, 3))
_CARD_FIRST = "3456"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def core_of(token: str) -> tuple[int, str]:
    """Where the token's core begins in it, and the core; a plus sign and round
    brackets are part of it."""
    left = token.lstrip(_EDGE)
    return len(token) - len(left), left.rstrip(_EDGE)


def shape_of(core: str) -> str:
    s = re.sub(r"[A-Z]", "A", re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "9", core)))
    return re.sub(r"(.)\1{2,}", r"\1\1+", s)


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def ip6(text: str) -> bool:
    try:
        return len([g for g in text.split(":") if g]) > 2 and any(c.isdigit() for c in text) and ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def introduced(text: str) -> dict[int, tuple[str, str]]:
    """{start: (kind, core)} of the tokens that something introduces."""
    found: dict[int, tuple[str, str]] = {}
    low = text.lower()

    def add(kind: str, start: int, part: str) -> None:
        for w in re.finditer(r"\S+", part):
            lead, core = core_of(w.group())
            if core:
                found.setdefault(start + w.start() + lead, (kind, core))

    if any(h in low for h in _CREDENTIAL_HINTS):
        for m in _CREDENTIAL.finditer(text):
            add("secret", m.start(1), m.group(1))
    if any(h in text for h in _PERSON_HINTS):
        for m in _PERSON.finditer(text):
            add("name", m.start(1), m.group(1))
    if any(h in text for h in _VENDOR_HINTS):
        for m in _VENDOR.finditer(text):
            add("vendor", m.start(), m.group())
    for m in _IBAN.finditer(text) if _IBAN_HINT.search(text) else ():
        if iban(m.group()):
            add("iban", m.start(), m.group())
    return found


def pieces(run: str) -> list[tuple[int, str]]:
    """(start, token) of the tokens of a run of non-blanks, without outer punctuation."""
    out: list[tuple[int, str]] = []
    if run.count(":") > 1:
        for m in _IP6.finditer(run):
            if ip6(m.group()):
                return [*pieces(run[: m.start()]), (m.start(), m.group()), *((m.end() + at, t) for at, t in pieces(run[m.end() :]))]

    def add(at: int, token: str) -> None:
        lead, core = core_of(token)
        if core:
            out.append((at + lead, core))

    for m in _PIECE.finditer(run):
        token, at = m.group(), m.start()
        core = core_of(token)[1]
        if _EMAIL.fullmatch(core) or _IP.fullmatch(core) or _OPAQUE.fullmatch(core):
            add(at, token)
            continue
        for w in re.finditer("[^/]+", token):
            last = 0
            for x in _WITHIN.finditer(w.group()) if "@" in w.group() or w.group().count(".") > 2 else ():
                add(at + w.start() + last, w.group()[last : x.start()])
                add(at + w.start() + x.start(), x.group())
                last = x.end()
            add(at + w.start() + last, w.group()[last:])
    return out


def number_groups(nodes: list) -> tuple[list[str], list[int]]:
    """For each node, what kind of number it may be a group of ('' for none), and the first
    node of that number (its own place for none).  A number's groups stand one blank apart."""
    n = len(nodes)
    kind, first = [""] * n, list(range(n))
    plain = [x[2].isascii() and x[2].isdigit() for x in nodes]
    k = 0
    while k < n:
        end = k + 1
        while end < n and plain[end] and nodes[end][5] == " ":
            end += 1
        got, size = "", 1
        if plain[k] and end > k + 2:
            for groups in _CARD_GROUPS:
                now = nodes[k : k + len(groups)]
                if k + len(groups) <= end and all(len(x[2]) == g for x, g in zip(now, groups)):
                    digits = "".join(x[2] for x in now)
                    valid = "cardgroups" + ("luhn" if luhn(digits) else "") + ("" if digits[0] in _CARD_FIRST else "otherfirst")
                    if not got or luhn(digits):
                        got, size = valid, len(groups)
                    if luhn(digits):
                        break
        if not got and nodes[k][6] == "iban":
            size = 1
            while k + size < n and nodes[k + size][6] == "iban" and nodes[k + size][5] == " ":
                size += 1
            got = "ibangroups"
        if not got and plain[k] and {b.lower() for b in nodes[k][3]} & _CALL:
            size, total = 1, len(nodes[k][2])
            while k + size < end and size < 5 and total + len(nodes[k + size][2]) <= 13:
                total += len(nodes[k + size][2])
                size += 1
            got, size = ("phonegroups", size) if total >= 9 else ("", 1)
        if not got and re.fullmatch(r"\+\d{1,3}", nodes[k][2]) and end > k + 1:
            size, total = 1, len(nodes[k][2]) - 1
            while k + size < end and 2 <= len(nodes[k + size][2]) <= 8 and total + len(nodes[k + size][2]) <= 15:
                total += len(nodes[k + size][2])
                size += 1
            got, size = ("phonegroups", size) if total >= 8 else ("", 1)
        if got:
            kind[k : k + size] = [got] * size
            first[k : k + size] = [k] * size
        k += size if got else 1
    return kind, first


def node_features(core: str, before: tuple[str, str], neighbours: tuple[str, str], group: str = "", cue: str = "") -> list[str]:
    """Features of a node; before: the two words that precede it in the text;
    neighbours: the cores of the adjacent nodes in the chain ('' for background);
    group: what kind of number it may be a group of; cue: what introduces it, or 'echo' if
    that happens elsewhere."""
    f = ["bias"]
    if group:
        f.append(group)
    if cue:
        f.append(f"cue:{cue}")
        if cue == "secret":
            f.append("cue&" + ("plain" if core.lower() in _PLAIN else "digit" if re.search(r"\d", core) else "short" if len(core) < 5 else "word"))
        elif cue in ("name", "echo") and not re.search(r"[\d@]", core):
            f.append(f"{cue}&" + ("plain" if core.lower() in _PLAIN else "capital" if core[:1].isupper() else "small"))
    if _SSN.fullmatch(core):
        f.append("ssn")
    digits = re.sub(r"\D", "", core)
    if _EMAIL.fullmatch(core):
        f.append("email")
    elif "@" in core:
        f.append("at")
    m = _IP.fullmatch(core)
    if ":" in core and ip6(core):
        f.append("ip")
    if m:
        f.append("ip" if all(int(g) < 256 for g in m.groups()) else "dotted4")
    if core.isascii() and core.isdigit():
        f.append(f"digits{min(len(core), 20)}")
        if 13 <= len(core) <= 19:
            f.append("luhn" if luhn(core) else "notluhn")
            if luhn(core):
                f.append("cardfirst" if core[0] in _CARD_FIRST else "otherfirst")
    elif tuple(map(len, core.split("-"))) in _CARD_GROUPS and digits == core.replace("-", "") and digits.isascii():
        f.append("cardgroups" + ("luhn" if luhn(digits) else "") + ("" if digits[0] in _CARD_FIRST else "otherfirst"))
    for name, text in (("own", core), ("prev", neighbours[0]), ("next", neighbours[1])):
        if re.fullmatch(r"\+\d{1,3}", text):
            f.append(f"{name}:country")
        elif re.fullmatch(r"\(\d{2,5}\)", text):
            f.append(f"{name}:area")
        elif re.fullmatch(r"\d{3}[-.]\d{4}", text):
            f.append(f"{name}:local")
        elif re.fullmatch(r"(\+?\d{1,3}[-.])?\(?\d{3}\)?[-.]\d{3}[-.]\d{4}|\+\d{8,15}|\+\d{1,3}([-.]\d{2,8}){2,5}", text):
            f.append(f"{name}:phone")
    if _HEX.fullmatch(core):
        f.append("hex")
    elif _OPAQUE.fullmatch(core):
        f.append("opaque")
    words = {b.strip(_EDGE + "()").lower() for b in before}
    if words & _KEYWORDS or any(_KEYWORDS & set(re.split(r"[_.-]", w)) for w in words):
        f.append("keyword")
        if "hex" in f or "opaque" in f:
            f.append("keyword&opaque")
    if len(f) == 1:
        f.append("other")
    return f


@dataclass
class Crf:
    feature: dict[str, int]
    weights: np.ndarray  # features x labels, log scale
    chain: np.ndarray  # labels x labels, log scale
    skip: float  # log scale, for equal labels

    def __post_init__(self):
        self._unary: dict[tuple, np.ndarray] = {}

    def unary(self, features: list[str]) -> np.ndarray:
        key = tuple(features)
        if key not in self._unary:
            if len(self._unary) > 20000:
                self._unary.clear()
            w = sum((self.weights[self.feature[f]] for f in features if f in self.feature), np.zeros(len(LABELS)))
            w = w - w.max()
            self._unary[key] = np.exp(w)
        return self._unary[key]


def nodes_of(text: str) -> list[tuple[int, int, str, tuple[str, str], bool, str, str]]:
    """(start, end, core, the two words before, whether the node before is adjacent, the text
    between it and this one if so, what introduces it)."""
    cues = introduced(text)
    cores = {core for kind, core in cues.values() if kind != "iban"}
    out: list = []
    last = -1  # the end of the run before
    ends_in_node = False
    before: list[str] = []
    for m in (_RUN if cues else _NODE).finditer(text):
        run = m.group()
        if cues and not re.search("[0-9@]", run) and not any(c in cues for c in range(m.start(), m.end())) and cores.isdisjoint(c for _, c in pieces(run)):
            continue
        found = pieces(run) or [(0, run)]
        gap = text[max(last, 0) : m.start()]
        near = ends_in_node and not gap.strip()
        # The last pieces of the gap have its last words, unless they are all punctuation.
        words = _WORD.findall(" ".join(gap.rsplit(None, 3)[-3:]))
        if len(words) < 2:
            words = [*before, *_WORD.findall(gap)]
        words = words[-2:]
        for at, core in found:
            start = m.start() + at
            cue = cues[start][0] if start in cues else "echo" if core in cores else ""
            if cue or re.search(r"[0-9@]", core):
                own = [*words, *_WORD.findall(run[:at])]
                out.append((start, start + len(core), core, ("", "", *own)[-2:], near, text[out[-1][1] : start] if near else "", cue))
                near = True
            else:
                near = False
        before = [*words, *_WORD.findall(run)][-2:]
        ends_in_node = near
        last = m.end()
    return out


def chain_of(nodes: list) -> tuple[list[list[str]], list[str], list[int]]:
    """The nodes' features, their cores for skip edges, and the first node of each one's number."""
    cores = [x[2] for x in nodes]
    joined = [x[4] for x in nodes] + [False]
    kind, first = number_groups(nodes)
    features = [
        node_features(cores[k], nodes[k][3], (cores[k - 1] if joined[k] else "", cores[k + 1] if joined[k + 1] else ""), kind[k], nodes[k][6])
        for k in range(len(nodes))
    ]
    whole: dict[int, str] = {}
    for k, c in enumerate(cores):
        whole[first[k]] = whole.get(first[k], "") + c
    return features, [whole[first[k]] if kind[k] else c.replace("-", "") if "cardgroupsluhn" in features[k] else c for k, c in enumerate(cores)], first


def skip_edges(cores: list[str]) -> list[tuple[int, int]]:
    """Pairs of a node and the next one that is the same or similar: a chain
    through each set of them, so their number stays linear."""
    out, seen = set(), {}
    for k, c in enumerate(cores):
        for key in (("=", c), ("~", shape_of(c), c[:8])):
            if key in seen:
                out.add((seen[key], k))
            seen[key] = k
    return sorted(out)


def marginals(unary: np.ndarray, chain_edges: list, skip: list, chain_pot: np.ndarray, skip_pot: np.ndarray) -> np.ndarray:
    """Loopy sum-product with flooding messages, until they no longer change.  The longest path
    there can be has as many edges as there are nodes, so it ends after that many rounds at
    most; beyond ROUNDS, messages that move back and forth are averaged with the ones before."""
    n, k = unary.shape
    edges = [(a, b, chain_pot) for a, b in chain_edges] + [(a, b, skip_pot) for a, b in skip]
    if not edges:
        return unary / unary.sum(axis=1, keepdims=True)
    src = np.array([e[0] for e in edges] + [e[1] for e in edges])
    dst = np.array([e[1] for e in edges] + [e[0] for e in edges])
    pot = np.stack([e[2] for e in edges] + [e[2].T for e in edges])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    log_u = np.log(unary + 1e-300)
    msg = np.zeros((len(src), k))
    last = np.zeros_like(msg)
    for turn in range(max(ROUNDS, n)):
        total = log_u.copy()
        np.add.at(total, dst, msg)
        out = total[src] - msg[back]
        out -= out.max(axis=1, keepdims=True)
        new = np.log(np.einsum("ei,eij->ej", np.exp(out), pot) + 1e-300)
        new -= new.max(axis=1, keepdims=True)
        change = np.abs(new - msg).max()
        if turn >= ROUNDS and np.abs(new - last).max() < change / 2:
            new = (new + msg) / 2
        last, msg = msg, new
        if change < 1e-6:
            break
    total = log_u.copy()
    np.add.at(total, dst, msg)
    total -= total.max(axis=1, keepdims=True)
    p = np.exp(total)
    return p / p.sum(axis=1, keepdims=True)


def decode(text: str, model: Crf) -> list[tuple[int, int, str, float]]:
    """(start, end, label, probability) of each entity; adjacent phone tokens are one, and so are a card's groups."""
    nodes = nodes_of(text)
    if not nodes:
        return []
    cores = [x[2] for x in nodes]
    n = len(nodes)
    joined = [x[4] for x in nodes] + [False]
    features, same, first = chain_of(nodes)
    unary = np.stack([model.unary(f) for f in features])
    skip_pot = np.exp(model.skip * np.eye(len(LABELS)))
    p = marginals(unary, [(k - 1, k) for k in range(1, n) if joined[k]], skip_edges(same), np.exp(model.chain), skip_pot)
    best = p.argmax(axis=1)
    out: list[tuple[int, int, str, float]] = []
    for k in range(n):
        if best[k] == 0:
            continue
        label, prob = LABELS[best[k]], float(p[k, best[k]])
        continued = first[k] != k if label in ("CARD", "ID") else joined[k] and nodes[k][5].isspace() if label == "NAME" else label == "PHONE" and joined[k] and not cores[k].startswith("+") and not set(nodes[k][5]) & _LIST
        if continued and k and best[k - 1] == best[k]:
            out[-1] = (out[-1][0], nodes[k][1], label, min(out[-1][3], prob))
        else:
            out.append((nodes[k][0], nodes[k][1], label, prob))
    return out


def _generated(rng: random.Random) -> list[tuple[list[str], list[int]]]:
    """Token sequences with labels: entities, look-alikes and repeats."""
    word = lambda: "".join(rng.choice(["an", "er", "the", "ti", "co", "ra", "ein", "que"]) for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card(valid: bool) -> str:
        while True:
            d = (rng.choice("44445365") if valid else rng.choice("0123456789")) + digits(15)
            if luhn(d) == valid:
                return d

    mail = lambda: f"{word()}{rng.choice(['.', '_', '', '+', '-'])}{rng.choice([word(), digits(2)])}@{word()}.{rng.choice(['com', 'org', 'info', 'ac.uk'])}"
    address = lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4))
    grouped = lambda d: [d[:4], d[4:8], d[8:12], d[12:]]

    def secret() -> str:
        letters = rng.choice(["0123456789abcdef", "0123456789ABCDEFGHKLMNPRSTabcdefghkmnoprstuvwxyz"])
        return "a1" + "".join(rng.choice(letters) for _ in range(rng.choice([24, 32, 40])))

    def item() -> tuple:  # tokens, labels, and what may be repeated bare
        k = rng.randrange(36)
        if k in (28, 29):
            kind = rng.choice(["password", "passwd", "Password", "pwd", "secret", "token", "passphrase", "db_password"])
            value = rng.choice([f"{word()}{digits(rng.randint(1, 4))}", f"{word()}{word()}", f"{word().title()}{digits(2)}!{word()}", word() + word()])
            return ([f"{kind}{rng.choice('=:')}{value}"], [5], [value]) if rng.random() < 0.5 else ([f"{kind}{rng.choice(':=')}", value], [0, 5], [value])
        if k == 30:
            value = rng.choice(sorted(_PLAIN))
            return [f"{rng.choice(['password', 'token', 'secret', 'api_key'])}{rng.choice(':=')}", value], [0, 0], [value]
        if k in (31, 32):
            parts = [word().title() + "ki" for _ in range(rng.randint(1, 3))]
            lead = rng.choice([["Mr."], ["Mrs."], ["Dr."], ["Dr"], ["Herr"], ["Frau"], ["name:"], ["Name:"], ["my", "name", "is"], ["Prof."]])
            return [*lead, *parts], [0] * len(lead) + [6] * len(parts), [parts[-1]]
        if k == 33:
            return [f"{rng.randint(1, 665):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"], [7]
        if k == 34:
            country, body = rng.choice(["DE", "FR", "GB", "ES"]), "".join(rng.choice("0123456789") for _ in range(18))
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            whole = f"{country}{check:02}{body}"
            t = [whole] if rng.random() < 0.5 else [whole[i : i + 4] for i in range(0, len(whole), 4)]
            return t, [7] * len(t)
        if k == 35:
            letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
            return rng.choice(
                [
                    (["AKIA" + "".join(rng.choice(letters) for _ in range(16))], [5]),
                    ([f"ghp_{''.join(rng.choice(letters.lower()) for _ in range(30))}"], [5]),
                    ([":".join(f"{rng.randrange(1 << 16):x}" for _ in range(8))], [4]),
                    ([f"2001:db8::{rng.randrange(1, 1 << 16):x}:{rng.randrange(1, 1 << 16):x}"], [4]),
                    ([rng.choice(["phone", "ring", "dial"]), f"0{digits(2)}", digits(7)], [0, 2, 2]),
                ]
            )
        if k == 14:
            return [rng.choice(["({})", "<{}>", "[{}]", "email:{}", "mail={}", "mailto:{}?x", "'{}'"]).format(mail())], [1]
        if k == 15:
            return [f"{mail()}{rng.choice(',;|/')}{mail()}"], [1]
        if k == 16:
            return [rng.choice(["({})", "ip={}", "http://{}/", "host:{}", "[{}]"]).format(address())], [4]
        if k == 17:
            d = card(True)
            return [rng.choice(["{}", "({})", "card:{}", "card={}"]).format("-".join(grouped(d)))], [3]
        if k == 18:
            return grouped(card(True)), [3] * 4
        if k == 19:
            return grouped(card(False)), [0] * 4
        if k == 20:
            return ["-".join(grouped(card(False)))], [0]
        if k == 21:
            return [f"{rng.choice(['api_key', 'secret', 'password', 'access_token'])}{rng.choice(['=', ':'])}{rng.choice(['', chr(34), chr(39)])}{secret()}"], [5]
        if k == 22:
            return rng.choice([[f"+{digits(rng.randint(9, 13))}"], [f"tel:+{rng.randint(1, 99)}-{digits(3)}-{digits(3)}-{digits(4)}"], [f"({digits(3)}){digits(3)}-{digits(4)}"]]), [2]
        if k == 23:
            t = [f"+{rng.randint(1, 99)}", *(digits(rng.randint(2, 4)) for _ in range(3)), digits(4)]
            return t, [2] * 5
        if k == 24:
            return [rng.choice(["phone", "tel:", "call"]), digits(3), digits(3), digits(4)], [0, 2, 2, 2]
        if k == 25:
            return [rng.choice([f"{digits(2)}:{digits(2)}", f"({digits(4)})", f"({digits(2)})", f"n={digits(3)}", f"{digits(1)},{digits(3)}", f"{digits(1)}/{digits(2)}/{digits(4)}", f"x@{word()}", f"@{word()}{digits(2)}"])], [0]
        if k == 26:
            return [rng.choice(["key", "token", "secret"]), rng.choice([digits(2), f"{word()}{digits(1)}", f"{digits(1)}.{digits(1)}"])], [0, 0]
        if k == 27:
            return [digits(rng.randint(1, 4)) for _ in range(rng.randint(2, 3))], [0] * 3
        if k == 0:
            return [f"{word()}{rng.choice(['.', '_', ''])}{digits(rng.randint(0, 2))}@{word()}{rng.choice(['', digits(1)])}.{rng.choice(['example.com', 'org', 'net', 'co.uk'])}"], [1]
        if k == 1:
            return [f"+{rng.randint(1, 99)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [2, 2, 2]
        if k == 2:
            return [rng.choice(["{0}-{1}-{2}", "({0})-{1}-{2}", "+1-{0}-{1}-{2}"]).format(digits(3), digits(3), digits(4))], [2]
        if k == 3:
            return [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [2, 2]
        if k == 4:
            return [card(True)], [3]
        if k == 5:
            return [card(False)], [0]
        if k == 6:
            return [".".join(str(rng.randint(0, 255)) for _ in range(4))], [4]
        if k == 7:
            return [".".join(str(rng.choice([300, 999, 512, 4])) for _ in range(3)) + ".999"], [0]
        if k == 8:
            return [rng.choice(["token", "key", "secret", "password"]), "=", '"' + "".join(rng.choice("0123456789abcdef") for _ in range(rng.choice([32, 40, 64]))) + '"'], [0, 0, 5]
        if k == 9:
            return [f"{rng.randint(0, 9)}.{rng.randint(0, 20)}{rng.choice(['', '.'])}"], [0]
        if k == 10:
            return [str(rng.randint(0, 99999))], [0]
        if k == 11:
            return [f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}"], [0]
        if k == 12:
            return [rng.choice([f"({digits(1)})", f"{word()}{digits(1)}", f"@{word()}", f"{digits(2)}%", f"+{digits(4)}", digits(9), digits(20)])], [0]
        return [rng.choice("0367819") + digits(11), word()], [0, 0]

    out = []
    for _ in range(3000):
        tokens, labels = [], []
        for _ in range(rng.randint(1, 3)):
            for _ in range(rng.randint(0, 3)):
                tokens.append(word())
                labels.append(0)
            t, y, *bare = item()
            end = rng.choice(["", "", "", ".", ",", "!!", "###", "***", "%%%"])
            for _ in range(rng.choice([1, 1, 1, 2])):
                tokens += [*t[:-1], t[-1] + end]
                labels += y[: len(t)]
                tokens.append(word())
                labels.append(0)
            for _ in range(rng.choice([0, 1, 2]) if bare else 0):
                fill = [word() for _ in range(rng.randint(0, 5))]
                tokens += [*fill, bare[0][0] + rng.choice(["", "", ".", ","]), word()]
                labels += [0] * len(fill) + [y[-1], 0]
        out.append((tokens, labels))
    return out


@lru_cache(maxsize=4)
def train(seed: int = 11) -> Crf:
    """The model, from generated text alone; nothing of the corpus goes into it."""
    rows, labels, left, skips = [], [], [], []
    for tokens, ys in _generated(random.Random(seed)):
        text = " ".join(tokens)
        starts, at = {}, 0
        for t, y in zip(tokens, ys):
            starts[at] = y
            at += len(t) + 1
        nodes = nodes_of(text)
        features, cores, _ = chain_of(nodes)
        base = len(rows)
        rows += features
        labels += [starts[text.rfind(" ", 0, x[0]) + 1] for x in nodes]
        left += [base + k - 1 if x[4] else -1 for k, x in enumerate(nodes)]
        skips += [(base + a, base + b) for a, b in skip_edges(cores)]
    feature = {f: k for k, f in enumerate(sorted({f for r in rows for f in r}))}
    n, k = len(rows), len(LABELS)
    x = np.zeros((n, len(feature)))
    for i, r in enumerate(rows):
        x[i, [feature[f] for f in r]] = 1
    y = np.eye(k)[labels]
    # What each node sees of its neighbours' labels: that before it, that after it, and the sum over skip edges.
    before, after, skipped = np.zeros((n, k)), np.zeros((n, k)), np.zeros((n, k))
    has = np.flatnonzero(np.array(left) >= 0)
    before[has], after[np.array(left)[has]] = y[np.array(left)[has]], y[has]
    for a, b in skips:
        skipped[a] += y[b]
        skipped[b] += y[a]
    w, chain, skip = np.zeros((len(feature), k)), np.zeros((k, k)), 0.0
    v, vc, vs = np.zeros_like(w), np.zeros_like(chain), 0.0
    for _ in range(600):
        z = x @ w + before @ chain + after @ chain.T + skip * skipped
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - y) / n
        v = 0.9 * v - 2.0 * (x.T @ g + 1e-5 * w)
        vc = 0.9 * vc - 2.0 * (before.T @ g + (after.T @ g).T + 1e-3 * chain)
        vs = 0.9 * vs - 0.5 * (float((g * skipped).sum()) + 1e-4 * skip)
        w, chain, skip = w + v, chain + vc, max(0.0, skip + vs)
    return Crf(feature, w, chain, skip)


def find_entities(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """(doc_id, start_char, end_char, label, probability) of each entity in each row.

    Positions count characters of the text from 0, the end is exclusive.  Null and
    empty texts have none; a null doc_id is returned as null; repeated rows each
    report theirs; other columns are not read; an empty table gives no rows.  Of
    equal marginals the first label in LABELS wins.
    """
    model = model or train()
    weights = (model.feature, model.weights, model.chain, model.skip)

    def run(batches):
        crf = Crf(*weights)
        for b in batches:
            ids, out = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for e in decode(t, crf) if t else ():
                    ids.append(i)
                    out.append(e)
            cols = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.float64())
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], names=["doc_id", "start_char", "end_char", "label", "probability"])

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, SCHEMA)


def redacted(text: str, crf: Crf) -> str:
    out, at = [], 0
    for start, end, label, _ in decode(text, crf):
        out += [text[at:start], f"<{label}>"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: Crf | None = None) -> DataFrame:
    """docs with each entity replaced by its label in angle brackets, and n_chars
    (where there is one) set to the new length; rows without entities are unchanged.

    Null and empty texts, and null ids, stay as they are; repeated rows stay repeated; other
    columns are carried whatever their names; a text of any length is read whole; an empty
    table gives no rows.  Ties are as in `find_entities`."""
    model = model or train()
    weights = (model.feature, model.weights, model.chain, model.skip)
    at = docs.columns.index("text")

    def run(batches):
        crf = Crf(*weights)
        for b in batches:
            new = [redacted(t, crf) if t else t for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(new, b.schema.field(at).type))

    out = map_arrow(docs, run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out

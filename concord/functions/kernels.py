"""String similarity kernels in plain Python, from the published algorithms."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache
from math import sqrt

from concord.settings import ABBREVIATIONS, ADDRESS_STOPS, POSTAL

_STOPS = frozenset(ADDRESS_STOPS)


def jaro(a: str, b: str) -> float:
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    moved = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro plus a bonus for up to four common first characters, where Jaro exceeds 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    n = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        n += 1
    return j + n * 0.1 * (1 - j)


def token_sort_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, " ".join(sorted(a.upper().split())), " ".join(sorted(b.upper().split()))).ratio()


def trigram_cosine(a: str, b: str) -> float:
    grams = lambda s: Counter([s] if len(s) < 3 else [s[i : i + 3] for i in range(len(s) - 2)])
    x, y = grams(a.upper()), grams(b.upper())
    dot = sum(n * y[g] for g, n in x.items())
    norm = sqrt(sum(n * n for n in x.values())) * sqrt(sum(n * n for n in y.values()))
    return dot / norm if norm else 0.0


def expanded(name: str) -> str:
    return " ".join(ABBREVIATIONS.get(t, t) for t in name.upper().split())


def abbreviation(a: str, b: str) -> float:
    return jaro_winkler(expanded(a), expanded(b))


def _words(addr: str) -> set[str]:
    return {t.rstrip(".,") for t in addr.upper().split()} - _STOPS


def address_jaccard(a: str, b: str) -> float:
    x, y = _words(a), _words(b)
    return len(x & y) / len(x | y) if x | y else 0.0


def _parts(addr: str) -> tuple[str, str]:
    t = addr.upper().split()
    number = ""
    if t and (d := t[0].replace("-", "")).isascii() and d.isdigit():
        number, t = t[0], t[1:]
    return number, " ".join(w for w in t[:3] if w not in _STOPS)


def address_components(a: str, b: str) -> float:
    found = [1.0 if x == y else jaro_winkler(x, y) for x, y in zip(_parts(a), _parts(b), strict=True) if x and y]
    return sum(0.3 * s for s in found) / sum(0.3 for _ in found) if found else 0.0


def postal(addr: str) -> str:
    return " ".join(POSTAL.get(t, t) for t in addr.upper().split())


def address_postal(a: str, b: str) -> float:
    x, y = postal(a), postal(b)
    return 1.0 if x == y else jaro_winkler(x, y)


_VOWELS = frozenset("AEIOUY")


class _Sounds:
    """A text on its way to its double metaphone: one method a letter, each of which returns the letter's codes and length.

    The rules are those of L. Philips, "The Double Metaphone Search Algorithm" (2000). Codes have their whole length,
    as texts of several words would all sound alike by their first four.
    """

    def __init__(self, text: str) -> None:
        self.s = text
        self.last = len(text) - 1
        self.slavic = any(x in text for x in ("W", "K", "CZ"))
        self.germanic = text.startswith(("VAN ", "VON ", "SCH"))
        self.i = 0

    def has(self, shift: int, *options: str) -> bool:
        """Whether one of ``options`` stands ``shift`` letters from here."""
        at = self.i + shift
        return at >= 0 and self.s.startswith(options, at)

    def vowel(self, shift: int) -> bool:
        at = self.i + shift
        return 0 <= at <= self.last and self.s[at] in _VOWELS

    def codes(self) -> tuple[str, str]:
        s, out = self.s, ["", ""]
        if s.startswith(("GN", "KN", "PN", "WR", "PS")):
            self.i = 1
        while self.i <= self.last:
            c = s[self.i]
            if self.vowel(0):
                found = ("A", "A", 1) if self.i == 0 else ("", "", 1)
            elif c in _PLAIN:
                found = (_PLAIN[c], _PLAIN[c], 1 + self.has(1, c))
            elif rule := getattr(self, f"_{c}", None):
                found = rule()
            else:
                found = ("", "", 1)
            out[0], out[1], self.i = out[0] + found[0], out[1] + found[1], self.i + found[2]
        return out[0], out[1]

    def _C(self) -> tuple[str, str, int]:
        i, has = self.i, self.has
        if i > 1 and not self.vowel(-2) and has(-1, "ACH") and not has(2, "I") and (not has(2, "E") or has(-2, "BACHER", "MACHER")) or has(0, "CHIA"):
            return "K", "K", 2
        if i == 0 and has(0, "CAESAR"):
            return "S", "S", 2
        if has(0, "CH"):
            return self._ch()
        if has(0, "CZ") and not has(-2, "WICZ"):
            return "S", "X", 2
        if has(1, "CIA"):
            return "X", "X", 3
        if has(0, "CC") and not (i == 1 and has(-1, "M")):
            if has(2, "I", "E", "H") and not has(2, "HU"):
                return ("KS", "KS", 3) if i == 1 and has(-1, "A") or has(-1, "UCCEE", "UCCES") else ("X", "X", 3)
            return "K", "K", 2
        if has(0, "CK", "CG", "CQ"):
            return "K", "K", 2
        if has(0, "CI", "CE", "CY"):
            return "S", "X" if has(0, "CIO", "CIE", "CIA") else "S", 2
        return "K", "K", 3 if has(1, " C", " Q", " G") else 2 if has(1, "C", "K", "Q") and not has(1, "CE", "CI") else 1

    def _ch(self) -> tuple[str, str, int]:
        i, has = self.i, self.has
        if i > 0 and has(0, "CHAE"):
            return "K", "X", 2
        greek = i == 0 and has(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM") and not has(0, "CHORE")
        hard = (i == 0 or has(-1, "A", "O", "U", "E")) and has(2, *"LRNMBHFVW ")
        if greek or self.germanic or has(-2, "ORCHES", "ARCHIT", "ORCHID") or has(2, "T", "S") or hard:
            return "K", "K", 2
        if i == 0:
            return "X", "X", 2
        return ("K", "K", 2) if self.s.startswith("MC") else ("X", "K", 2)

    def _D(self) -> tuple[str, str, int]:
        if self.has(0, "DG"):
            return ("J", "J", 3) if self.has(2, "I", "E", "Y") else ("TK", "TK", 2)
        return "T", "T", 1 + self.has(1, "T", "D")

    def _G(self) -> tuple[str, str, int]:
        i, has = self.i, self.has
        if has(1, "H"):
            if i > 0 and not self.vowel(-1):
                return "K", "K", 2
            if i == 0:
                return ("J", "J", 2) if has(2, "I") else ("K", "K", 2)
            if has(-2, "B", "H", "D") or has(-3, "B", "H", "D") or has(-4, "B", "H"):
                return "", "", 2
            if i > 2 and has(-1, "U") and has(-3, *"CGLRT"):
                return "F", "F", 2
            return ("", "", 2) if has(-1, "I") else ("K", "K", 2)
        if has(1, "N"):
            if i == 1 and self.vowel(-1) and not self.slavic:
                return "KN", "N", 2
            return ("N", "KN", 2) if not has(2, "EY") and not self.slavic else ("KN", "KN", 2)
        if has(1, "LI") and not self.slavic:
            return "KL", "L", 2
        if i == 0 and has(1, "Y", "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER"):
            return "K", "J", 2
        if has(1, "ER", "Y") and not self.s.startswith(("DANGER", "RANGER", "MANGER")) and not has(-1, "E", "I", "RGY", "OGY"):
            return "K", "J", 2
        if has(1, "E", "I", "Y") or has(-1, "AGGI", "OGGI"):
            if self.germanic or has(1, "ET"):
                return "K", "K", 2
            return "J", "J" if has(1, "IER ") or has(1, "IER") and i + 3 == self.last else "K", 2
        return "K", "K", 1 + has(1, "G")

    def _H(self) -> tuple[str, str, int]:
        return ("H", "H", 2) if (self.i == 0 or self.vowel(-1)) and self.vowel(1) else ("", "", 1)

    def _J(self) -> tuple[str, str, int]:
        i, has = self.i, self.has
        if has(0, "JOSE") or self.s.startswith("SAN "):
            alone = i == 0 and (has(4, " ") or i + 3 == self.last)
            return ("H", "H", 1) if alone or self.s.startswith("SAN ") else ("J", "H", 1)
        step = 1 + has(1, "J")
        if i == 0:
            return "J", "A", step
        if self.vowel(-1) and not self.slavic and has(1, "A", "O"):
            return "J", "H", step
        if i == self.last:
            return "J", "", step
        return ("", "", step) if has(1, *"LTKSNMBZ") or has(-1, "S", "K", "L") else ("J", "J", step)

    def _L(self) -> tuple[str, str, int]:
        if not self.has(1, "L"):
            return "L", "L", 1
        spanish = self.i == self.last - 2 and self.has(-1, "ILLO", "ILLA", "ALLE") or self.s.endswith(("AS", "OS", "A", "O")) and self.has(-1, "ALLE")
        return "L", "" if spanish else "L", 2

    def _M(self) -> tuple[str, str, int]:
        silent = self.has(-1, "UMB") and (self.i + 1 == self.last or self.has(2, "ER"))
        return "M", "M", 2 if silent or self.has(1, "M") else 1

    def _P(self) -> tuple[str, str, int]:
        return ("F", "F", 2) if self.has(1, "H") else ("P", "P", 1 + self.has(1, "P", "B"))

    def _R(self) -> tuple[str, str, int]:
        french = self.i == self.last and not self.slavic and self.has(-2, "IE") and not self.has(-4, "ME", "MA")
        return "" if french else "R", "R", 1 + self.has(1, "R")

    def _S(self) -> tuple[str, str, int]:
        i, has = self.i, self.has
        if has(-1, "ISL", "YSL"):
            return "", "", 1
        if i == 0 and has(0, "SUGAR"):
            return "X", "S", 1
        if has(0, "SH"):
            return ("S", "S", 2) if has(1, "HEIM", "HOEK", "HOLM", "HOLZ") else ("X", "X", 2)
        if has(0, "SIO", "SIA"):
            return "S", "S" if self.slavic else "X", 3
        if i == 0 and has(1, "M", "N", "L", "W") or has(1, "Z"):
            return "S", "X", 1 + has(1, "Z")
        if has(0, "SC"):
            if not has(2, "H"):
                return ("S", "S", 3) if has(2, "I", "E", "Y") else ("SK", "SK", 3)
            if has(3, "ER", "EN"):
                return "X", "SK", 3
            if has(3, "OO", "UY", "ED", "EM"):
                return "SK", "SK", 3
            return "X", "S" if i == 0 and not self.vowel(3) and not has(3, "W") else "X", 3
        french = i == self.last and has(-2, "AI", "OI")
        return "" if french else "S", "S", 1 + has(1, "S", "Z")

    def _T(self) -> tuple[str, str, int]:
        if self.has(0, "TION", "TIA", "TCH"):
            return "X", "X", 3
        if self.has(0, "TH", "TTH"):
            return ("T", "T", 2) if self.has(2, "OM", "AM") or self.germanic else ("0", "T", 2)
        return "T", "T", 1 + self.has(1, "T", "D")

    def _W(self) -> tuple[str, str, int]:
        i, has = self.i, self.has
        if has(0, "WR"):
            return "R", "R", 2
        if i == 0 and (self.vowel(1) or has(0, "WH")):
            return "A", "F" if self.vowel(1) else "A", 1
        if i == self.last and self.vowel(-1) or has(-1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or self.s.startswith("SCH"):
            return "", "F", 1
        return ("TS", "FX", 4) if has(0, "WICZ", "WITZ") else ("", "", 1)

    def _X(self) -> tuple[str, str, int]:
        if self.i == 0:
            return "S", "S", 1
        french = self.i == self.last and (self.has(-3, "IAU", "EAU") or self.has(-2, "AU", "OU"))
        sound = "" if french else "KS"
        return sound, sound, 1 + self.has(1, "C", "X")

    def _Z(self) -> tuple[str, str, int]:
        if self.has(1, "H"):
            return "J", "J", 2
        double = self.has(1, "ZO", "ZI", "ZA") or self.slavic and self.i > 0 and not self.has(-1, "T")
        return "S", "TS" if double else "S", 1 + self.has(1, "Z")


#: letters with one sound
_PLAIN = {"B": "P", "F": "F", "K": "K", "N": "N", "Q": "K", "V": "F"}


@lru_cache(50_000)
def metaphones(s: str) -> tuple[str, str]:
    """Primary and secondary double metaphone of a whole text; what is no letter A-Z has no sound but parts the letters beside it."""
    return _Sounds("".join(c if "A" <= c <= "Z" else " " for c in s.upper().strip())).codes()


def phonetic(a: str, b: str) -> float:
    (p, s), (q, t) = metaphones(a), metaphones(b)
    return float(any(x and x == y for x, y in ((p, q), (p, t), (s, q))))


def _best(scores: list[tuple[str, float]]) -> tuple[float, str]:
    """The largest score; ties go to the first."""
    name, value = max(scores, key=lambda x: x[1])
    return value, name


def select_name(a: str, b: str) -> tuple[str, ...]:
    """The name strategies that are tried for a pair; of equal scores the first wins."""
    a, b = a.upper().strip(), b.upper().strip()
    if any(t in ABBREVIATIONS for t in (*a.split(), *b.split())):
        return ("NAME_ABR", "NAME_JW", "NAME_TSR")
    longest = max(len(a), len(b))
    if longest and min(len(a), len(b)) / longest < 0.6:
        return ("NAME_TSR", "NAME_ABR")
    return ("NAME_JW", "NAME_PHO", "NAME_NGR") if longest <= 20 else ("NAME_JW", "NAME_NGR")


def select_address(a: str, b: str) -> tuple[str, ...]:
    return ("ADDR_CMP", "ADDR_NRM") if all(any(c.isdigit() for c in x[:10]) for x in (a, b)) else ("ADDR_JAC",)


_ROUTED = {"NAME_ABR": abbreviation, "NAME_JW": jaro_winkler, "NAME_TSR": token_sort_ratio, "NAME_PHO": phonetic, "NAME_NGR": trigram_cosine, "ADDR_CMP": address_components, "ADDR_NRM": address_postal, "ADDR_JAC": address_jaccard}


def route_name(a: str, b: str) -> tuple[float, str]:
    x, y = a.upper().strip(), b.upper().strip()
    return _best([(k, round(_ROUTED[k](x, y), 4)) for k in select_name(a, b)])


def route_address(a: str, b: str) -> tuple[float, str]:
    return _best([(k, round(_ROUTED[k](a, b), 4)) for k in select_address(a, b)])

"""Labelled findings for the secret scan: values of known kinds, placed in texts of the corpus.

Each kind draws a value and how it is written; its label says whether such a value is a secret. Labels come from the
kind alone, never from what a scan measures of the value. Draws are seeded by the text they are placed in.
"""

from __future__ import annotations

import base64
import random
import string
import uuid
from collections.abc import Callable
from typing import NamedTuple

ALNUM = string.ascii_letters + string.digits
HEX = "0123456789abcdef"


class Placed(NamedTuple):
    before: str
    value: str
    after: str = ""


class Kind(NamedTuple):
    secret: bool
    draw: Callable[[random.Random, list[str]], Placed]


def _pick(dice: random.Random, letters: str, n: int) -> str:
    return "".join(dice.choices(letters, k=n))


def _base64(dice: random.Random, n: int) -> str:
    return base64.b64encode(dice.randbytes(n)).decode()


def _written(dice: random.Random, value: str, named: float = 0.6) -> Placed:
    """A value as configuration, code or prose would have it: assigned to a name, or bare."""
    if dice.random() > named:
        return Placed(*dice.choice([("", value), ("(", value, ")"), ("`", value, "`"), ("key ", value), ("", value, ",")]))
    name = dice.choice(["token", "secret", "password", "api_key", "API_KEY", "access_key", "auth", "DB_PASSWORD", "client_secret", "my_token"])
    return Placed(*dice.choice([(f"{name}=", value), (f"{name}: ", value), (f'{name} = "', value, '"'), (f"{name}='", value, "'"), (f'"{name}": "', value, '",')]))


def _named(dice: random.Random, value: str) -> Placed:
    return _written(dice, value, 1.0)


def _token(dice: random.Random, words: list[str]) -> Placed:
    part = lambda n: _pick(dice, ALNUM + "-_", n)
    return _written(dice, f"eyJ{part(dice.randrange(12, 60))}.eyJ{part(dice.randrange(20, 200))}.{part(43)}")


def _digest(dice: random.Random, words: list[str]) -> Placed:
    before = dice.choice(["commit ", "sha256:", "sha1 ", "md5: ", "checksum ", "digest: ", "revision ", "etag ", "sha256sum ", "hash: "])
    return Placed(before, _pick(dice, HEX, dice.choice([32, 40, 64])))


def _slug(dice: random.Random, words: list[str]) -> Placed:
    parts = dice.choices(words, k=dice.randrange(3, 8)) + [str(dice.randrange(2030))] * dice.randrange(1, 3)
    dice.shuffle(parts)
    return Placed(dice.choice(["", "see ", "/", "id "]), "-".join(parts))


def _path(dice: random.Random, words: list[str]) -> Placed:
    names = [w + dice.choice(["", "", str(dice.randrange(100))]) for w in dice.choices(words, k=dice.randrange(3, 8))]
    return Placed(dice.choice(["/", "", "from ", "./"]), "/".join([*names, f"v{dice.randrange(10)}"]))


def _identifier(dice: random.Random, words: list[str]) -> Placed:
    parts = dice.choices(words, k=dice.randrange(3, 7)) + [str(dice.randrange(100))]
    joined = "_".join(parts) if dice.random() < 0.5 else parts[0] + "".join(p.capitalize() for p in parts[1:])
    return Placed(dice.choice(["", "def ", "call ", "`"]), joined.upper() if dice.random() < 0.2 else joined)


def _stamp(dice: random.Random, words: list[str]) -> Placed:
    day = f"20{dice.randrange(10, 30)}-{dice.randrange(1, 13):02}-{dice.randrange(1, 29):02}"
    return Placed("", dice.choice([f"{day}-{_pick(dice, string.digits, 6)}", f"{day}_backup_{_pick(dice, string.digits, 4)}", f"v{dice.randrange(9)}-{day}-rc{dice.randrange(9)}"]))


def _serial(dice: random.Random, words: list[str]) -> Placed:
    digits = lambda n: _pick(dice, string.digits, n)
    words = [w.upper() for w in dice.choices(words, k=2)]
    value = dice.choice([f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}", f"{words[0]}-{words[1]}-{digits(8)}", f"{digits(3)}-{digits(3)}-{digits(4)}-{digits(4)}", f"{words[0]}{digits(4)}_{words[1]}{digits(8)}"])
    return Placed(dice.choice(["", "ISBN ", "no. ", "order "]), value)


def _address(dice: random.Random, words: list[str]) -> Placed:
    pairs = "-".join(_pick(dice, HEX, 2) for _ in range(dice.choice([6, 8])))
    return Placed(dice.choice(["", "mac ", "device "]), dice.choice([pairs, pairs.upper(), f"0x{_pick(dice, '0', 8)}{_pick(dice, HEX, 8)}"]))


def _placeholder(dice: random.Random, words: list[str]) -> Placed:
    name = dice.choice(["password", "token", "secret", "key"])
    return _named(dice, dice.choice([f"your_{name}_here", "xxxxxxxxxxxxxxxx", f"<your-{name}>", f"${{{name.upper()}}}", "changeme", "********", f"example_{name}", f"os.environ[{name}]", "AKIA" + "X" * 16, "ghp_" + "x" * 36]))


def _word(dice: random.Random, words: list[str]) -> Placed:
    value = "".join(dice.choices(words, k=dice.randrange(1, 5)))
    return _named(dice, value if len(value) >= 6 else value * 6)


KINDS: dict[str, Kind] = {
    "aws_key_id": Kind(True, lambda d, w: _written(d, d.choice(["AKIA", "ASIA"]) + _pick(d, string.ascii_uppercase + string.digits, 16))),
    "github_token": Kind(True, lambda d, w: _written(d, f"gh{d.choice('pousr')}_{_pick(d, ALNUM, 36)}")),
    "slack_token": Kind(True, lambda d, w: _written(d, f"xox{d.choice('abprs')}-{_pick(d, string.digits, 12)}-{_pick(d, ALNUM, 24)}")),
    "google_key": Kind(True, lambda d, w: _written(d, "AIza" + _pick(d, ALNUM + "_-", 35))),
    "jwt": Kind(True, _token),
    "hex_key": Kind(True, lambda d, w: _written(d, _pick(d, HEX, d.choice([24, 32, 40, 48, 64])))),
    "alphanumeric_key": Kind(True, lambda d, w: _written(d, _pick(d, ALNUM, d.randrange(20, 65)))),
    "base64_key": Kind(True, lambda d, w: _written(d, _base64(d, d.randrange(18, 49)))),
    "upper_key": Kind(True, lambda d, w: _written(d, _pick(d, string.ascii_uppercase + string.digits, d.randrange(20, 41)))),
    "grouped_key": Kind(True, lambda d, w: _written(d, "-".join(_pick(d, ALNUM, 8) for _ in range(d.randrange(3, 6))))),
    "prefixed_key": Kind(True, lambda d, w: _written(d, d.choice(["sk_live_", "pk_", "key-", "SG."]) + _pick(d, ALNUM, d.randrange(24, 48)))),
    "password": Kind(True, lambda d, w: _named(d, _pick(d, ALNUM + "!#%&*+-.:?@^_~", d.randrange(8, 24)))),
    "digest": Kind(False, _digest),
    "uuid": Kind(False, lambda d, w: Placed(d.choice(["", "id ", "uuid:", "request "]), str(uuid.UUID(int=d.getrandbits(128), version=4)))),
    "slug": Kind(False, _slug),
    "path": Kind(False, _path),
    "identifier": Kind(False, _identifier),
    "prose64": Kind(False, lambda d, w: Placed(d.choice(["", "base64,"]), base64.b64encode(" ".join(d.choices(w, k=d.randrange(4, 12))).encode()).decode())),
    "digits": Kind(False, lambda d, w: Placed(d.choice(["", "card ", "no. ", "+"]), _pick(d, string.digits, d.randrange(16, 24)))),
    "stamp": Kind(False, _stamp),
    "serial": Kind(False, _serial),
    "address": Kind(False, _address),
    "placeholder": Kind(False, _placeholder),
    "word": Kind(False, _word),
}


def plant(text: str, draws: int, kinds: list[str]) -> list[tuple[str, str, int, int]]:
    """(kind, text, start, end) of values put between words of ``text``, one in each of ``draws`` copies of its surroundings."""
    dice = random.Random(text)
    words = text.split()
    plain = [w.lower() for w in words if w.isalpha() and len(w) > 2] or ["word", "text", "line"]
    out = []
    for _ in range(draws):
        kind = dice.choice(kinds)
        at = dice.randrange(len(words) + 1)
        before, after = " ".join(words[max(0, at - 8) : at]), " ".join(words[at : at + 8])
        gap = dice.choice([" ", " ", "\n"]) if before else ""
        placed = KINDS[kind].draw(dice, plain)
        head = before + gap + placed.before
        out.append((kind, head + placed.value + placed.after + (" " + after if after else ""), len(head), len(head) + len(placed.value)))
    return out

"""Made lines that a tagger of secrets learns from: forms of secrets, and things
that look like them but are none, in surroundings of a corpus's own words.

Each form is a function of a source of randomness to the pieces of a line; a
piece that is a secret is a list of one string.
"""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Callable

Pieces = list[str | list[str]]
Form = Callable[[random.Random], Pieces]

LETTERS, DIGITS = string.ascii_letters, string.digits
LOWER, UPPER = string.ascii_lowercase, string.ascii_uppercase


def drawn(rng: random.Random, alphabet: str, least: int, most: int | None = None) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(least, most or least)))


def mixed(rng: random.Random, alphabet: str, least: int, most: int | None = None) -> str:
    """Drawn with a digit and a letter at least."""
    while True:
        found = drawn(rng, alphabet, least, most)
        if any(c in DIGITS for c in found) and any(c in LETTERS for c in found):
            return found


def b64(rng: random.Random, n_bytes: int) -> str:
    return base64.b64encode(rng.randbytes(n_bytes)).decode()


def url64(rng: random.Random, n_bytes: int) -> str:
    return base64.urlsafe_b64encode(rng.randbytes(n_bytes)).decode().rstrip("=")


def named(names: tuple[str, ...], value: Callable[[random.Random], str]) -> Form:
    """``name = value`` in its many spellings."""

    def form(rng: random.Random) -> Pieces:
        name = rng.choice(names)
        name = rng.choice((name, name.upper(), name.capitalize(), "my_" + name, "DB_" + name.upper()))
        sep = rng.choice(("=", ": ", " = ", ":", " : ", " => ", "=", ": "))
        quote = rng.choice(("", "", '"', "'"))
        start = rng.choice(("", "", "export ", "- ", "  ", '"'))
        closing = '"' if start == '"' else ""
        return [start + name + closing + sep + quote, [value(rng)], quote + rng.choice(("", "", ";", ",", "\n"))]

    return form


def password(rng: random.Random) -> str:
    """As people make them: words with digits and marks, or any characters."""
    if rng.random() < 0.5:
        word = drawn(rng, LOWER, 4, 8)
        return rng.choice((word, word.capitalize())) + drawn(rng, DIGITS, 1, 4) + rng.choice(("", "!", "_x", "-" + drawn(rng, LOWER, 3), drawn(rng, LOWER, 3)))
    return mixed(rng, LETTERS + DIGITS + "_-.+", 9, 20)


def token(rng: random.Random) -> str:
    return rng.choice(
        (
            lambda: mixed(rng, LETTERS + DIGITS, 20, 44),
            lambda: mixed(rng, LOWER + DIGITS, 16, 40),
            lambda: mixed(rng, UPPER + DIGITS, 16, 32),
            lambda: b64(rng, rng.randint(15, 40)),
            lambda: url64(rng, rng.randint(15, 40)),
            lambda: mixed(rng, "0123456789ABCDEF", 24, 40),
        )
    )()


PASSWORD_NAMES = ("pwd", "pass", "password", "passphrase", "db_pass", "passwd", "login_password")
KEY_NAMES = ("secret_key", "access_key", "client_secret", "private_key", "auth_token", "credentials",
             "api_key", "aws_secret", "signing_key", "token", "secret", "apikey", "access_token")


def bearer(rng: random.Random) -> Pieces:
    head = rng.choice(("Authorization: Bearer ", "authorization: bearer ", "-H 'Authorization: token ", "Bearer "))
    return [head, [token(rng)], rng.choice(("", "'", "\n"))]


def web_token(rng: random.Random) -> Pieces:
    value = f"eyJ{url64(rng, rng.randint(15, 30))}.eyJ{url64(rng, rng.randint(30, 90))}.{url64(rng, 32)}"
    return [rng.choice(("", "jwt ", "token ", "id_token: ", "cookie: session=")), [value]]


def prefixed(rng: random.Random) -> Pieces:
    value = rng.choice(
        (
            lambda: "ghp_" + mixed(rng, LETTERS + DIGITS, 36),
            lambda: "glpat-" + mixed(rng, LETTERS + DIGITS + "_-", 20),
            lambda: f"xoxb-{drawn(rng, DIGITS, 11)}-{drawn(rng, DIGITS, 12)}-{mixed(rng, LETTERS + DIGITS, 24)}",
            lambda: "sk_live_" + mixed(rng, LETTERS + DIGITS, 24, 40),
            lambda: "AIza" + mixed(rng, LETTERS + DIGITS + "_-", 35),
            lambda: f"SG.{mixed(rng, LETTERS + DIGITS, 22)}.{mixed(rng, LETTERS + DIGITS, 43)}",
        )
    )()
    return [rng.choice(("", "use ", "key ", "with ")), [value], rng.choice(("", " ", "."))]


def key_body(rng: random.Random) -> Pieces:
    kind = rng.choice(("RSA ", "EC ", "", "OPENSSH "))
    body: Pieces = [f"-----BEGIN {kind}PRIVATE KEY-----\n"] if rng.random() < 0.6 else []
    for _ in range(rng.randint(1, 3)):
        body += [[b64(rng, 48)], "\n"]
    return body


def in_address(rng: random.Random) -> Pieces:
    scheme = rng.choice(("postgres", "https", "mysql", "amqp", "redis", "mongodb"))
    return [f"{scheme}://{drawn(rng, LOWER, 4, 8)}:", [password(rng)], f"@{drawn(rng, LOWER, 3, 9)}.example.org/db"]


def aws(rng: random.Random) -> Pieces:
    name = rng.choice(("AWS", "aws_secret_access_key", "AWS_SECRET_ACCESS_KEY", "secretAccessKey"))
    return [name + rng.choice(("=", " = ", ": ")), [b64(rng, 30)]]


def bare(rng: random.Random) -> Pieces:
    head = rng.choice(("the key is ", "the key = ", "here is the token ", "key ", "secret ", "my password is ", "login with "))
    return [head, [mixed(rng, LETTERS + DIGITS, 16, 40)], rng.choice(("", ".", " ok"))]


SECRETS: dict[str, Form] = {
    "password": named(PASSWORD_NAMES, password),
    "key": named(KEY_NAMES, token),
    "bearer": bearer,
    "web_token": web_token,
    "prefixed": prefixed,
    "key_body": key_body,
    "in_address": in_address,
    "aws": aws,
    "bare": bare,
}


def n(rng: random.Random, least: int, most: int) -> str:
    return str(rng.randint(least, most))


def one_of(*forms: Callable[[random.Random], str]) -> Form:
    return lambda rng: [rng.choice(forms)(rng)]


def word(rng: random.Random) -> str:
    return drawn(rng, LOWER, 3, 9)


HARMLESS: dict[str, Form] = {
    "number": one_of(
        lambda r: n(r, 0, 9999), lambda r: n(r, 10**6, 10**15), lambda r: f"{n(r, 0, 999)}.{n(r, 0, 99)}",
        lambda r: f"${n(r, 1, 999)},{r.randint(0, 999):03d}", lambda r: f"{n(r, 1, 100)}%",
        lambda r: " ".join(n(r, 0, 10**6) for _ in range(8)), lambda r: n(r, 1, 31) + r.choice(("st", "nd", "rd", "th")),
    ),
    "date": one_of(
        lambda r: f"{n(r, 1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
        lambda r: f"{n(r, 1, 28)}.{n(r, 1, 12)}.{n(r, 1990, 2030)}", lambda r: f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}",
        lambda r: f"20{r.randint(10, 30)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}T{r.randint(0, 235959):06d}Z",
    ),
    "reference": one_of(
        lambda r: f"order {r.choice(UPPER)}{n(r, 10**5, 10**8)}", lambda r: f"see commit {drawn(r, '0123456789abcdef', 7, 12)} and order {r.choice(UPPER)}{n(r, 10**6, 10**7)}",
        lambda r: f"invoice no. {r.choice(UPPER)}{r.choice(UPPER)}-{n(r, 10**4, 10**7)}", lambda r: f"ISBN 978-{n(r, 0, 9)}-{n(r, 10, 999)}-{n(r, 10**4, 10**5)}-{n(r, 0, 9)}",
        lambda r: f"ticket {n(r, 10**6, 10**10)}",
        lambda r: f"#{drawn(r, '0123456789abcdef', 6)}", lambda r: f"room {n(r, 1, 99)}{r.choice(UPPER)}", lambda r: f"doi 10.{n(r, 1000, 9999)}/{word(r)}.{n(r, 2000, 2030)}.{n(r, 10**4, 10**6)}",
    ),
    "uuid": one_of(lambda r: r.choice(("", "id ", "id=")) + "-".join(drawn(r, "0123456789abcdef", k) for k in (8, 4, 4, 4, 12))),
    "contact": one_of(
        lambda r: f"{word(r)}.{n(r, 1, 99)}@mail{n(r, 1, 9)}.example.com", lambda r: f"{word(r)}@{word(r)}.org", lambda r: f"+{n(r, 1, 99)} ({n(r, 100, 999)}) {n(r, 100, 999)}-{n(r, 1000, 9999)}",
        lambda r: ".".join(n(r, 0, 255) for _ in range(4)), lambda r: f"0{n(r, 10, 999)} {n(r, 10**5, 10**8)}",
    ),
    "address": one_of(
        lambda r: f"https://www.{word(r)}.com/{word(r)}/{n(r, 1, 99999)}?id={n(r, 1, 10**6)}&page={n(r, 1, 9)}", lambda r: f"/usr/lib/{word(r)}/{word(r)}-{n(r, 1, 9)}.{n(r, 0, 20)}.so",
        lambda r: f"C:\\{word(r).capitalize()}\\{word(r)}{n(r, 1, 99)}.txt", lambda r: f"http://{word(r)}.example.org:{n(r, 80, 9999)}/{word(r)}_{word(r)}",
    ),
    "code": one_of(
        lambda r: f"{word(r)}{word(r).capitalize()}{word(r).capitalize()}({n(r, 0, 99)})", lambda r: f"{word(r)}_{word(r)}_{word(r)} = {n(r, 0, 9999)}",
        lambda r: f"version {n(r, 0, 20)}.{n(r, 0, 20)}.{n(r, 0, 99)}-{r.choice(('beta', 'rc'))}{n(r, 1, 9)}", lambda r: f"for (int i{n(r, 0, 9)} = 0; i < {n(r, 10, 10**6)}; i++)",
        lambda r: f"{word(r).capitalize()}{word(r).capitalize()}{r.choice(('Factory', 'Error', 'Manager'))}", lambda r: f"utf{n(r, 8, 32)} x86_{n(r, 32, 64)} sha{n(r, 1, 512)}",
    ),
    "placeholder": one_of(
        lambda r: f"{r.choice(PASSWORD_NAMES + KEY_NAMES)}{r.choice(('=', ': ', ' = '))}{r.choice(('<your key>', '${VALUE}', 'None', '\"\"', 'get_token()', 'os.environ', 'required', 'changeable', '...', '********', 'true'))}",
        lambda r: f"the {r.choice(PASSWORD_NAMES + KEY_NAMES)} has {n(r, 4, 64)} characters", lambda r: f"key: {word(r)}", lambda r: f"token {word(r)} {word(r)}",
        lambda r: f"max_tokens = {n(r, 1, 10**5)}", lambda r: f"password policy {n(r, 1, 99)}",
    ),
    "word": one_of(
        lambda r: drawn(r, LOWER, 20, 30), lambda r: drawn(r, UPPER, 3, 24), lambda r: f"{word(r)}-{word(r)}-{word(r)}-{word(r)}", lambda r: "-" * 40, lambda r: "=" * 30,
        lambda r: word(r) * 4, lambda r: f"{n(r, 2, 99)}{r.choice(('kg', 'mm', 'km', 'px', 'GB', 'ms'))}", lambda r: f"{r.choice(UPPER)}{n(r, 1, 99)}",
    ),
}


def line(form: Form, words: list[str], rng: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A text with a form's pieces among ``words``, and the places of its secrets."""

    def some(most: int) -> str:
        return " ".join(rng.choices(words, k=rng.randint(0, most))) if words else ""

    text, spans = some(6), []
    text += " " if text and rng.random() < 0.9 else "\n" if text else ""
    for piece in form(rng):
        if isinstance(piece, list):
            spans.append((len(text), len(text) + len(piece[0])))
            text += piece[0]
        else:
            text += piece
    after = some(6)
    return text + rng.choice((" ", "\n", ", ")) * bool(after) + after, spans

"""Labelled spans to plant into texts: formats of private and of harmless ones, with
the words that stand around them.  op10_pii learns from them."""

from __future__ import annotations

import random
import string

HEX, WORDY = "0123456789abcdef", string.ascii_letters + string.digits
NAMES = "anna ben carla david elena felix greta hugo ines jonas klara lukas maria noah olga paul rosa simon tina vera".split()
HOSTS = "example mailbox company school office garden studio market harbor river".split()
ENDINGS = "com org net de fr es io edu co.uk info".split()
WORDS = "value table input result report figure page update list image night house north market order".split()


def signs(rng: random.Random, alphabet: str, least: int, most: int | None = None) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randint(least, most or least)))


def shaped(rng: random.Random, shape: str) -> str:
    """The shape with a digit for every 9."""
    return "".join(rng.choice(string.digits) if c == "9" else c for c in shape)


def key(rng: random.Random) -> str:
    kind = rng.randrange(8)
    if kind < 3:
        return signs(rng, HEX if rng.random() < 0.8 else HEX.upper(), rng.choice((32, 40, 64)))
    if kind < 6:
        return signs(rng, WORDY, 20, 44) + "1"
    if kind == 6:
        return signs(rng, WORDY + "+/", 24, 44) + "9="
    return signs(rng, WORDY + "-_", 20, 40) + "7"


def marked_key(rng: random.Random) -> str:
    """Keys that are known by their own form."""
    kind = rng.randrange(4)
    if kind == 0:
        return "AKIA" + signs(rng, string.ascii_uppercase + string.digits, 15) + "4"
    return ("ghp_", "sk-", "xoxb-")[kind - 1] + signs(rng, WORDY, 30, 40) + "3"


def identifier(rng: random.Random) -> str:
    parts = [rng.choice(WORDS) for _ in range(rng.randint(3, 6))]
    join = rng.choice(("_", "-", "/"))
    return join.join([*parts, signs(rng, string.digits, 1, 4)])


def file_name(rng: random.Random) -> str:
    return rng.choice(("IMG_", "report-", "backup_")) + shaped(rng, "99999999_999999")


PHONES = ("(999) 999-9999", "999-999-9999", "999.999.9999", "0999 9999999", "099/9999999", "09 99 99 99 99", "999 999 999", "0999-999999", "(099) 99999999", "9 999 999-99-99")
PERSONAL = ("999-99-9999", "99 9999 9999 9999 9999 99", "99999999999", "999 999 9999")
HARMLESS = ("9999999", "99999999", "9999999999", "999999999999", "9999999999999999", "9999999999999999999", "978-9-99-999999-9", "9999-99-99 99.99", "99.999999 99.999999", "9.99999999", "99.99.9999 99", "9.9.9.9.9.9.9", "999 999 999")


def address(rng: random.Random) -> str:
    user = rng.choice(NAMES) + rng.choice(("", ".", "_")) + rng.choice(("", *NAMES)) + rng.choice(("", signs(rng, string.digits, 1, 3)))
    at = rng.choice((" [at] ", " (at) ", "[at]", "(at)", " (AT) ", " [AT] "))
    dot = rng.choice((" [dot] ", " (dot) ", ".", "[dot]", " (DOT) "))
    return f"{user}{at}{rng.choice(HOSTS)}{dot}{rng.choice(ENDINGS)}"


def remark(rng: random.Random) -> str:
    """What looks like an address and isn't."""
    return f"{rng.choice(WORDS)} (at) {rng.choice(WORDS)}{rng.choice(('.', ' . '))}{rng.choice(WORDS)}"


#: Where a span stands; {} is the span.
OF_KEYS = ('token = "{}"', "token={}", "TOKEN = {}", 'api_key: "{}"', "API_KEY={}", "password: {}", "secret='{}'", "Authorization: Bearer {}", '"access_key": "{}"', "credentials {}", "client secret is {}", "passwd={}", "auth token: {}", "my private key {}")
OF_HASHES = ("commit {}", "sha256: {}", 'checksum = "{}"', "build {}", "md5={}", 'etag: "{}"', "revision {}", "object {}", "hash {}", "{}", "{}", "{}")
OF_PHONES = ("call {}", "tel: {}", "phone {}", "Phone: {}", "mobile {}", "Tel. {}", "fax: {}", "WhatsApp {}", "reach me at {}", "dial {}", "Telefon {}", "ring {} today", "cell {}")
OF_PERSONS = ("ssn {}", "SSN: {}", "social security number {}", "iban {}", "account {}", "passport {}", "tax id {}")
OF_NUMBERS = ("order {}", "invoice no. {}", "ISBN {}", "ticket {}", "article {}", "serial {}", "population {}", "item {}", "lot {}", "size {}", "{}", "{}", "{}", "{}")
OF_ADDRESSES = ("mail {}", "write to {}", "contact: {}", "{}", "{}", "e-mail {}")
OF_REMARKS = ("{}", "see {}", "and {}")


def draw(rng: random.Random) -> tuple[str, bool, str, str, str]:
    """(kind, private, what stands before, span, what stands after); a third is private."""
    pick = rng.randrange(18)
    if pick < 3:
        made = ("secret", True, OF_KEYS, key(rng))
    elif pick == 3:
        made = ("secret", True, OF_KEYS + ("{}",) * 6, marked_key(rng))
    elif pick < 6:
        made = ("number", True, OF_PHONES, shaped(rng, rng.choice(PHONES))) if pick == 4 else ("number", True, OF_PERSONS, shaped(rng, rng.choice(PERSONAL)))
    elif pick == 6:
        made = ("contact", True, OF_ADDRESSES, address(rng))
    elif pick < 11:
        made = ("secret", False, OF_HASHES, key(rng))
    elif pick == 11:
        made = ("secret", False, ("{}", "file {}", "see {}"), rng.choice((identifier, file_name))(rng))
    elif pick < 17:
        made = ("number", False, OF_NUMBERS, shaped(rng, rng.choice(HARMLESS)))
    else:
        made = ("contact", False, OF_REMARKS, remark(rng))
    kind, private, contexts, span = made
    before, _, after = rng.choice(contexts).partition("{}")
    return kind, private, before, span, after

"""The small labelled table from which the tagger of personal information is trained.

Lines are made from marked templates. ``{n}`` and ``{N}`` stand for a name, ``{e}`` an email address, ``{p}`` a phone number, ``{i}`` a personal
number and ``{s}`` a street address; these are labelled. ``{w}`` is a plain word, ``{W}`` and ``{c}`` a capitalised one (``{c}`` a known word), ``{U}`` one in capitals, ``{h}`` a hash, ``{u}`` a uuid, ``{x}`` encoded binary data, ``{y}`` a password, ``{d}`` a short
and ``{D}`` a long number, ``{z}`` two digits, ``{T}`` a time stamp, ``{G}`` a German-looking noun, ``{b}`` an account handle, ``{g}`` a given name used as a word; these stay unlabelled. Besides whole lines there are
frames: any kind, or what only looks like one, among random words, so that the tagger can't lean on known sentences alone.
"""

from __future__ import annotations

import random

KINDS = {"n": "name", "N": "name", "e": "email", "p": "phone", "i": "idnum", "s": "street"}

# Line templates in public formats (mail headers, commit trailers, patches, contact and address forms, tables, code).
TEMPLATES = """
Author: {N} <{e}>
Author: {N}
Author: {b}
author: {b}
AuthorDate: {c} {c} {d} {z}:{z}:{z} 2024 +0100
Commit: {N} <{e}>
Committer: {b}
committer {N} <{e}> {T} +0200
From: {N} <{e}>
From: "{N}" <{e}>
From: {N}
From: {b}
To: {e}
To: {N} <{e}>, {N} <{e}>
Sender: {e}
Reply-To: {n} <{e}>
Cc: {e}
Bcc: {e}
Return-Path: <{e}>
From {h} Mon Sep 17 00:00:00 2001
From {h} on behalf of {b}
# User {N} <{e}>
# User {N}
# User {b}
# HG changeset patch
# Node ID {h}
# Parent {h}
Signed-off-by: {N} <{e}>
Signed-off-by: {b}
Reviewed-by: {N}
Reviewed-by: {b}
Acked-by: {N}
Tested-by: {N} <{e}>
Helped-by: {N}
Suggested-by: {N}
Reported-by: {N} <{e}>
Mentored-by: {N}
Co-authored-by: {N} <{e}>
we owe this to {n}
spotted by {n} while triaging
bisected by {n} and {n}
{n} asked for a shorter {w}
{n} wants the {w} gone
{n} und {n} haben das geprüft
original idea: {n}
talked it over with {n} last week
according to {n} the {w} was never {w}
credit goes to {n}, who found the {w}
many thanks, {n}!
ask {n} before you {w} the {w}
gemeldet von {n} am {d}.{d}.
Idee von {n}, umgesetzt von {n}
propuesto por {n} ayer
sugerido por {n} na reunião
d'après une idée de {n}
signalé par {n} hier
maintainer = {n}
assignee: {n}
approver: {n} # {w}
attendees: {n}, {n}, {n}
Dear {n},
Kind regards, {n}
Best, {n}
{n} ({p})
{n} / {e} / {p}
{n}; {p}
{n}: {w} the {w}
// {n}, {d}.{d}.2024
(c) 2024 {n}
@author {n}
@author {b}
FN:{n}
TEL;TYPE=cell:{p}
EMAIL:{e}
ADR:;;{s};{W};;{D};
write to {e} for access
please mail {e} and {e}
send the logs to {e}
{e} holds the keys
maintainer_email="{e}"
contact = {e}
mailto:{e}
<a href="mailto:{e}">{w}</a>
list of owners: {e}; {e}
schreib an {e}
escribe a {e}
écrire à {e}
Phone: {p}
Phone {p}, ask for {n}
Tel. {p}
Tel: {p}
tel:{p}
tel:{p};ext={d}
<a href="tel:{p}">{w}</a>
mobile {p}
mobile: {p} ({w})
fax {p}
hotline {p}, weekdays only
dial {p} x{d}
dial {p} ext {d}
{p} ext. {d}
{p}, ext. {d}
ring {p} when the pager fails
sms to {p} failed
pager={p}
the new number is {p}
replace {p} by {p}
Telefon {p}
tél. {p}
telefone {p}
teléfono: {p}
WhatsApp {p}
{i}
# {i}
{i}, {n}
{n}, {i}
{n} ({i})
fixture has {i} of {n}
drop {i} from the seed data
log line leaked {i}
the {w} prints {i} unmasked
never store {i} in a {w}
row {d}: {i}
{w};{i};{w}
deliver to {s}
deliver to {s}, {D} {W}
parcel for {n}, {s}, {D} {W}
{n}, {s}
address: {s}
address: {s}, {W}
Address {s} ({w} floor)
billing address {s}; {w} {w}
our office moved to {s}
moved from {s} to {s}
{n} moved to {s}
{n} works at {s}, {D} {W}
visit us at {s}, {c} {c}
wohnhaft {s}, {D} {W}
domicilio: {s}
adresse : {s}, {D} {W}
morada {s}
street={s}
{s}, {W}
{s}, {D} {W}
{s} (rear entrance)
{s}; second door
{"name": "{n}", "street": "{s}", "phone": "{p}"}
{"owner": "{n}", "mail": "{e}"},
"street": "{s}",
"phone": "{p}",
INSERT INTO {w} VALUES ({d}, '{n}', '{p}', '{s}');
INSERT INTO {w} VALUES ('{e}', '{n}');
UPDATE {w} SET name = '{n}' WHERE id = {D};
('{n}', '{s}'),
{d};{n};{s};{e}
{D},{n},{e},{p}
| {n} | {e} | {p} |
diff --git a/{w}/{w}_{w}.py b/{w}/{w}_{w}.py
index {h}..{h} 100644
index {h}..{h} 100644
index {h}..{h} 100755
index {h}..{h}
index {h}..{h} 100644
new file mode 100644
old mode 100755
--- a/{w}/{w}.java
+++ b/{w}/{w}.java
@@ -{d},{d} +{d},{d} @@ {w}{W}
@@ -{d},{d} +{d},{d} @@
Date: {W}, {d} {c} 2024 {z}:{z}:{z} +0200
Date:   2024-{z}-{z} {z}:{z} +0{d}00
# Date 2024-{z}-{z} {z}:{z}
commit {h}
Merge: {h} {h}
This reverts commit {h}.
(cherry picked from commit {h})
Revert "{W} {w} {w}"
Merge pull request #{d} from {w}{d}/{w}-{d}
Merge branch '{w}/{w}-{d}' into {w}
Subject: [PATCH v{d} {d}/{d}] {w}: {w} {w}
{w}: bump {w} to {d}.{d}.{d}
{w}=={d}.{d}.{d}
"{w}": "^{d}.{d}.{d}",
{w}@{d}.{d}.{d}
pinned {w}-{w}@{d}.{d}.{d}
@{w}.{w}
    @{w}.{w}(name="{w}")
# @{w}.{w}
git@{w}.{w}.example:{w}/{w}.git
clone git@{w}.{w}.example:{w}/{w}.git
url = ssh://git@{w}.{w}.example/{w}.git
{w}.url=jdbc:{w}://{w}:{y}@{w}.{w}.test:{D}/{w}
DSN={w}://{w}:{y}@{w}.{w}.test/{w}
{w}_url={w}://{w}:{y}@{w}.{w}.example/{w}
"{w}": "{w}://{w}:{y}@{w}.test:{D}"
{w}: "{h}"
{w}_token = "{h}"
bind {d}.{d}.{d}.{d}:{D}
# bind 10.{d}.{d}.{d}:{D}
{w} {D}-{D}
# {w} {D}-{D}
{w} {D}..{D}
{w} from 0{d}-{D} to 0{d}-{D}
{w} {d}-{d}-{d}
# {w} {d}-{d}-{d}
{w} 2024{z}{z}-{D}
# {w} 2024{z}{z}-{D}
{w} {T}
# {w} {T}
{w} +{D}{D} {w}
# {w} +{D}{D} {w}
{w} -{D}{D}
{w} 0x{h} X{d}
# {w} 0x{h}
{u}
{w} {u}
# {w} {u}
id={u}
sha256:{h}{h}
# {w} sha256:{h}{h}
-----BEGIN {U} {U}-----
-----END {U} {U}-----
{U} {U} {w} {U}, {w} {w} {U} {U}
{U} {U}
# {U} {U}
{U} A {U} {U} {w}
{w} {w} {U} {U} {U} {w} {d} {U}
{w} {U} {U} A {U} {U}
{w} to {U} EACH {U} {w}
{U} THE {U} {w} {w} {U} {U}.
# {w} {U} {U} {w}
{c} {c} {U} {w}
{U} {W} {d}
{x}
{x}
z{x}
z{x}
{w} at {w} dot {w}
# {w} at {w} dot {w}
- {w} at {w} dot {w}
meet at {w} {d}, then dot the {w}
{g} {c}
{g} {c} {w}
# {g} {c}
# {g} {c} {w}
- {g} {c} {w}
    {g} {c} {w}
{g} {c} and {g} {c}
{g} {c} and {c} {c} {w}
# {g} {c} {c}, {g} {c} {w}
# {c} {c} {c}, {g} {c} {w}
# {g} {c}, {g} {c} {w}
{c} {c}
{c} {c} {w}
# {c} {c} {w} {w}
{c} {c} {c}
{w} the {c} {c}
{d} {c} {w}
# {d} {c} {w} {w}
{d} {c} {c}
{w} {d} {c} {w} in {w}{W}.java
{w} {d} {w} {w}
# {w} {d} {w} {w}
see {d} {w} {W} {w}
{W} {d}
{W} {w} {d}
{W} {w} {W} {w}.
{W} {w} in {w} {w}.
{W} the {w} {w} with {d} {w}s, or {w} an {w} {w}.
Given {d} {w}s and a {w}, {w} the {w}. {W} {w} {w}.
{G} der {G} {w}
{G} der {G} und {G}
{G} {G} {w}
{G} für die {G} {w}
{G} im {G} nicht {w}
{w} {G} beim {G} der {G}
{G} {G} {w}
{G} {w}
Neue {G} für den {G}
Die {G} wird im {G} {w}
Ajout de la {w} pour les {w}
Supprime le {w} du {w}
Añade la {w} del {w}
Corrige el {w} de la {w}
Corrige a {w} do {w} de {w}
Remove o {w} da {w}
{W} der {w} und {w}
{W} de la {w}
{W} de {w} {w}
import {w}.{w}
SELECT {w}, count(*) FROM {w}_{w} WHERE {w} > {D}
static final int {W}_{W} = {D};
def {w}{W}({w}, {w}=None):
class {W}{W}({W}):
assert {w}_{w}({D}) == {d}
{w}.warn("{w} {w} %d", {D})
val {w}{W} = {w}.map(_.{w})
{w} = [{D}, {D}, {D}]
const {w}{W} = await {w}({D});
// {w} {w}, see {U}-{D}
"{w}": "{w}-{D}",
  {w}_{w}: {D}
{w}({w}): {W} {w}
[{w}] {W} {w} ({d} {w}s)
{w}({w}): {d}.{d}.{d} [skip {w}]
Binary files a/{w}/{w}.png and b/{w}/{w}.png differ
"""

# Surroundings without meaning, for every kind and for what only looks like one.
FRAMES = """
{K}
# {K}
+ {K}
({K})
'{K}',
{w} {w} {K}
{w} {K} {w} {w}
{K} {w} {w}
{w}: {K}
{w}={K}
{w} {w}, {K}.
{w} {w} ({K}) {w}
{W} {w} {w} {K}; {w} {w}
{d};{K};{w}
// {w} {K}
{w} {K} {w}
{w} {K}
{K} {w}
{K}; {w} {w}
[{K}]
"{w}": "{K}",
{w}, {K}
* {K}
{K} ({w})
{K}.
> {w} {K}
{w} - {K}
{K} - {w} {w}
{w} {w} {w} {K} {w} {w} {w}
{W} {w} {K} {w} {w} {w}.
{w}, {w} {K}, {w}
{K}, {K}
""".split("\n")[1:-1]
LOOKALIKES = "{w}-{w} {d}.{d}.{d}|{D}-{D}|10.{d}.{d}.{d}|{h}|{u}|2024-{z}-{z} {z}:{z}|{T}|{w}/{w}{W}.java|{w}@{d}.{d}.{d}|git@{w}.example:{w}/{w}.git|{c} {c}|{g} {c}|{g} {c} {w}|{c} {c} {c}|{d} {c} {w}|0{d}-{D} to 0{d}-{D}|{D} {D}|{U}-{D}|{w} at {w} dot {w}".split("|")

# Parts of surrogate values.
ONSETS = "b br c ch d dr f fl g gr h j k kl l m n p pr qu r s sch st t tr v w z".split()
VOWELS = "a e i o u a e i o ae ou ei".split()
NAME_ENDS = "sen ova ski ic ez mann hof ari ild rup gart ley son berg tel x".split()
GIVEN = "Anna Peter Maria John Carlos Lucia Pierre Claire Giulia Marco Ahmed Fatima Ivan Olga Lars Ingrid Jan Eva Pedro Ana Hans Birgit Paul Julia Tomas Petra Victor Elena Andre Sofia Erik Nina Jorge Laura".split()
WORDS = "add remove update fix test build cache queue table index user page file path node job task key list field block theme view form parser server client error retry limit report split merge copy move name street road number call order period curve notes links twice at the for of on in with after before until not".split()
HOSTS = "example.com example.org example.net mail.example.com web.example.org corp.example.net post.example lab.test mx.invalid mail.local.example staff.example.co.uk".split()
ENDS = "com org net de fr es example example.com example.org example.net invalid test co.uk".split()
STREET_ENDS = "Road Rd Rd. Street St St. Lane Ave Ave. Avenue Close Terrace Crescent Drive Court Way Place Square Hill".split()
LABELS = "SSN=|SSN |ssn: |social security no. |nino: |NI number |passport |national id |numéro national |documento nº |tax id |carte d'identité |Personalausweis |DNI |codice fiscale |personal number |id card no. |Steuer-ID |Reisepass Nr. |passport no. |NINO |CPF |NIF ".split("|")
HANDLES = "build-bot ci-runner release-bot docs-robot sync-daemon lint-service merge-helper".split()


class Surrogates:
    """Draws surrogate values."""

    def __init__(self, given_names: list[str], seed: int, words: tuple[str, ...] = ()):
        self.r = random.Random(seed)
        self.plain = words or WORDS
        self.known = sorted(given_names) or GIVEN

    def stem(self, most: int = 3) -> str:
        return "".join(self.r.choice(ONSETS) + self.r.choice(VOWELS) for _ in range(self.r.randint(1, most))).capitalize() + self.r.choice(["", "", "n", "r", "lk", "x", "rt", "nd", "sk"])

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def given(self) -> str:
        return self.r.choice(self.known if self.r.random() < 0.7 else GIVEN) if self.r.random() < 0.85 else self.stem(2) + "a"

    def surname(self) -> str:
        s = self.stem() + self.r.choice([*NAME_ENDS, ""])
        return self.r.choices([s, f"{s}-{self.stem()}{self.r.choice(NAME_ENDS)}", f"O'{s}", f"van {s}", f"de {s}"], [20, 2, 2, 1, 1])[0]

    def n(self, plain: float = 0.03) -> str:
        g, s = self.given(), self.c() if self.r.random() < plain else self.surname()
        got = self.r.choices([f"{g} {s}", f"{g} {self.r.choice('ABCDEFGHKLMPRST')}. {s}", f"{g[0]}. {s}", f"{s}, {g}"], [10, 3, 4, 3])[0]
        return got.upper() if self.r.random() < 0.1 else got

    def N(self) -> str:
        """A name in a place where only names stand, so the surname may well be a plain word."""
        return self.n(0.2)

    def y(self) -> str:
        return "".join(self.r.choice("0123456789ABCDEFGHJKMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz") for _ in range(self.r.randint(8, 16)))

    def z(self) -> str:
        return f"{self.r.randint(0, 59):02d}"

    def T(self) -> str:
        return "17" + self.digits(self.r.choice([8, 11]))

    def G(self) -> str:
        stem = self.stem(2)
        if self.r.random() < 0.4:
            stem = stem.translate(str.maketrans("aou", "äöü"))
        return stem + self.r.choice(["ung", "heit", "keit", "schaft", "e", "en", "er", "eln", "ieren", "ion"])

    def e(self) -> str:
        g, s = self.given().lower(), self.surname().lower().replace("'", "").replace(" ", "")
        local = self.r.choice([f"{g}.{s}", f"{g}_{s}", f"{g[0]}{s}", f"{s}{self.digits(2)}", g, f"{g}+{self.r.choice(WORDS)}"])
        at = self.r.choices(["@", " at ", " [at] ", "(at)"], [12, 2, 2, 2])[0]
        part = lambda: self.r.choice([self.stem(2).lower(), self.r.choice(self.plain), f"{self.stem(1).lower()}{self.r.randint(1, 9)}", f"{self.stem(1).lower()}-{self.r.choice(WORDS)}"])
        host = self.r.choice([self.r.choice(HOSTS), f"{part()}.{self.r.choice(ENDS)}", f"{part()}.{part()}.{self.r.choice(ENDS)}"])
        got = local + at + (host.replace(".", " dot ") if at == " at " else host)
        return self.r.choices([got, got.upper() if at == "@" else got, got.title() if at == "@" else got], [10, 1, 1])[0]

    def p(self) -> str:
        d = self.digits
        return self.r.choice([
            f"+44 7700 900{d(3)}", f"07700 900{d(3)}", f"+447700900{d(3)}", f"020 7946 0{d(3)}", f"(202) 555-0{d(3)}", f"+1 202-555-0{d(3)}", f"1-202-555-0{d(3)}",
            f"202.555.0{d(3)}", f"+61 491 570 {d(3)}", f"+49 30 23125{d(3)}", f"030/23125 {d(3)}", f"+33 1 99 00 {d(2)} {d(2)}", f"0033 199 00 {d(2)} {d(2)}", f"01.99.00.{d(2)}.{d(2)}",
        ])

    def i(self) -> str:
        d = self.digits
        number = self.r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"9{d(2)} {d(2)} {d(4)}", f"QQ {d(2)} {d(2)} {d(2)} {self.r.choice('ABCD')}", f"X{d(8)}", d(11), f"{d(2)} {d(3)} {d(3)} {d(3)}", f"QQ{d(6)}{self.r.choice('ABCD')}"])
        return self.r.choice(LABELS) + "\x01" + number

    def s(self) -> str:
        n = str(self.r.randint(1, 299)) + self.r.choices(["", "a", "b", "c"], [6, 1, 1, 1])[0]
        two = f" {self.stem(2)}" if self.r.random() < 0.5 else ""
        return self.r.choice([
            f"{n} {self.stem()}{two} {self.r.choice(STREET_ENDS)}", f"{n} {self.stem()} {self.r.choice(STREET_ENDS)}", f"{n} {self.c()} {self.r.choice(STREET_ENDS)}", f"{self.stem()}{self.r.choice(['weg', 'straße', 'straße', 'gasse', 'allee', 'str.'])} {n}", f"{self.stem()}{self.r.choice(['weg', 'straße', 'platz'])} {n}",
            f"Calle {self.stem()} {n}", f"Rua {self.stem()}, {n}", f"{n} rue de {self.stem()}", f"Via {self.stem()} {n}",
        ])

    def w(self) -> str:
        r = self.r.random()
        return self.r.choice(WORDS) if r < 0.35 else self.r.choice(self.plain) if r < 0.8 else self.stem(2).lower()

    def W(self) -> str:
        return self.r.choice([*[self.w().capitalize()] * 5, self.stem()])

    def c(self) -> str:
        return self.r.choice(WORDS if self.r.random() < 0.3 else self.plain).capitalize()

    def h(self) -> str:
        return "".join(self.r.choice("0123456789abcdef") for _ in range(self.r.choice([7, 12, 40])))

    def d(self) -> str:
        return str(self.r.randint(0, 99))

    def D(self) -> str:
        return self.digits(self.r.choice([4, 5]))

    def U(self) -> str:
        return self.w().upper()

    def x(self) -> str:
        return "".join(self.r.choice("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz!#$%&()*+-;<=>?@^_`{|}~") for _ in range(self.r.randint(20, 64)))

    def u(self) -> str:
        return "-".join("".join(self.r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12))

    def b(self) -> str:
        return self.r.choice([self.r.choice(HANDLES), self.w() + self.d(), f"{self.w()}-{self.r.choice(['bot', 'robot', 'daemon', 'ci', 'service', 'sync'])}", f"{self.stem(2).lower()}{self.d()}"])

    def g(self) -> str:
        return self.r.choice(["Mark", "Will", "Penny", "Rose", "Grace", "Jordan", "Amber", "Iris", "Frank", *self.known])


def templates() -> list[str]:
    """All line templates: whole lines, and each frame with each kind and each look-alike."""
    framed = [f.replace("{K}", k) for f in FRAMES for k in (*(f"{{{c}}}" for c in "nnepiss"), *LOOKALIKES)]
    return [*(t for t in TEMPLATES.split("\n") if t), *framed]


def labelled_lines(given_names: list[str], copies: int = 24, seed: int = 1, words: tuple[str, ...] = (), lines: list[str] | None = None) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines with their labelled spans (start, end, kind), made from ``lines`` or from all templates; ``words``: more plain words."""
    made = Surrogates(given_names, seed, words)
    out = []
    for template in (templates() if lines is None else lines) * copies:
        text, spans, at = made.r.choice(["", "", "    ", "+", "-", "+    ", "-# "]), [], 0
        while at < len(template):
            c = template[at : at + 3]
            if len(c) == 3 and c[0] == "{" and c[2] == "}":
                value = getattr(made, c[1])()
                label, _, number = value.rpartition("\x01")
                text += label
                if c[1] in KINDS:
                    spans.append((len(text), len(text) + len(number), KINDS[c[1]]))
                text += number
                at += 3
            else:
                text += template[at]
                at += 1
        out.append((text, spans))
    return out

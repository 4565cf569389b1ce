"""A deterministic labelled corpus: templated files in which every secret's place is known."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
HEX = "0123456789abcdef"


def make(kind: str, rng: random.Random) -> str:
    """A value of a kind, put together from its prefix and filler."""
    of = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    if kind == "pii_card":
        body = "4" + of("0123456789", 14)
        check = -sum((d * 2 - 9 if d > 4 else d * 2) if k % 2 == 0 else d for k, d in enumerate(map(int, reversed(body)))) % 10
        return body + str(check)
    return {
        "aws": lambda: "AKIA" + of(ALNUM[:26] + "0123456789", 16), "github": lambda: "ghp_" + of(ALNUM, 36), "stripe": lambda: "sk_" + "live_" + of(ALNUM, 24), "password": lambda: of(ALNUM, 22),
        "pii_email": lambda: f"{of(HEX, 6)}@corp.example.com", "pii_ssn": lambda: f"{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", "pii_phone": lambda: f"({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
    }[kind]()


#: The files. A field is kind, class and variant between braces.
TEMPLATES = {
    "secrets/app.env": "# settings\nAWS_KEY={aws|secrets|real}\nGITHUB={github|secrets|real}\nDEBUG=true\nPASSWORD={password|secrets|real}\n",
    "secrets/config.json": '{"stripe": "{stripe|secrets|real}", "region": "eu-west-1"}\n',
    "secrets/example.env": "password = {=changeme|secrets|placeholder}\napi_key = {=your_api_key|secrets|placeholder}\n",
    "secrets/build.log": "commit {=0123456789abcdef0123456789abcdef01234567|secrets|lookalike} built\n",
    "pii/people.csv": "name,mail,ssn,phone\na,{pii_email|pii_email|real},{pii_ssn|pii_ssn|real},{pii_phone|pii_phone|real}\nb,{pii_email|pii_email|real},{pii_ssn|pii_ssn|real},{pii_phone|pii_phone|real}\n",
    "pii/payments.log": "paid with {pii_card|pii_card|real}\nrefund to {pii_card|pii_card|real}.\norder {=4111111111111112|pii_card|lookalike}\n",
}


def corpus(seed: int = 7) -> tuple[list[tuple[str, str]], list[tuple[str, int, int, int, str, str, str]]]:
    """Files (file, text) and labels (file, ordinal, start, end, class, variant, value)."""
    rng, files, labels = random.Random(seed), [], []
    for name, template in TEMPLATES.items():
        text, rest = "", template
        while "|" in rest:
            at = rest.rindex("{", 0, rest.index("|"))
            text += rest[:at]
            field, rest = rest[at + 1 : rest.index("}", at)], rest[rest.index("}", at) + 1 :]
            kind, klass, variant = field.split("|")
            value = kind[1:] if kind.startswith("=") else make(kind, rng)
            labels.append((name, len(labels), len(text), len(text) + len(value), klass, variant, value))
            text += value
        files.append((name, text + rest))
    return files, labels


def corpus_tables(spark: SparkSession, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    files, labels = corpus(seed)
    return spark.createDataFrame(files, "file string, text string"), spark.createDataFrame(labels, "file string, ordinal int, start int, end int, class string, variant string, value string")

"""Cases that earlier versions missed: long chains of names, forms of literals, and near copies without ids."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from signalloom.llm import secrets, simhash  # noqa: E402

KEY = "q8Zr71LmPx02VbKd83hQ"


def literals(text):
    return [text.encode()[a:b].decode() for a, b, _ in secrets.literals(text.encode())]


@pytest.mark.parametrize("n", [1, 50, 150, 5000])
def test_chains_of_names_of_any_length(n):
    forward = [f'n0 = "{KEY}"', *[f"n{i + 1} = n{i}" for i in range(n)], f"password = n{n}"]
    assert literals("\n".join(forward)) == literals("\n".join(reversed(forward))) == [KEY]
    assert literals("\n".join(f"n{i} = n{(i + 1) % n}" for i in range(n)) + "\npassword = n0") == []


@pytest.mark.parametrize(
    "text",
    [
        'config["password"] = "{}"', "os.environ['API_TOKEN'] = '{}'", 'password = b"{}"', 'password = f"{}"', 'password = """{}"""', 'password = ("{}")', "password: |\n  {}", "<password>{}</password>",
        'define("DB_PASSWORD", "{}")', 'x = os.getenv("API_TOKEN", "{}")', "password: >-\n  {}\n", "secret = rb'{}'", 'password = "{}"', "DB_PASSWORD={}",
    ],
)
def test_forms_of_literals(text):
    assert literals(text.format(KEY)) == [KEY]


@pytest.mark.parametrize("text", ['print("the token", "of my esteem")', 'get("password", "")', "<b>token</b>", 'f("password", name)', 'password = os.environ["PASSWORD"]', 'table["token"] == "' + KEY + '"'])
def test_what_assigns_nothing(text):
    assert literals(text) == []


def test_near_copies_without_ids_are_one_group(spark):
    words = [f"w{i * 7919 % 1000}" for i in range(200)]
    variants = [" ".join([*words[:k], f"odd{k}", *words[k + 1 :]]) for k in (3, 90, 180)]
    kinds = "doc_id long, text string, source string"
    for ids in ((1, None, None), (None, None, None), (1, 2, None)):
        rows = [(i, t, "s") for i, t in zip(ids, variants, strict=True)] + [(None, "something else entirely " * 3, "s"), (9, "nothing like the others at all here", "s")]
        left = simhash.keep_unlike(spark.createDataFrame(rows, kinds)).collect()
        assert len(left) == 3 and sum(r["text"] in variants for r in left) == 1
        assert {r["doc_id"] for r in left if r["text"] in variants} == {ids[0]}

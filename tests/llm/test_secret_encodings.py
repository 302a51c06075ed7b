"""One random string of each alphabet is tested; words are not."""
import random
from string import ascii_lowercase as lower, ascii_uppercase as upper, digits

from partweave.llm import secrets


def test_secret_encodings(spark):
    draw = random.Random(3)
    alphabets = {"base32_lower": lower + "234567", "base36": lower + digits, "base36_upper": upper + digits, "letters": upper + lower,
                 "base38": lower + digits + "_-", "base38_upper": upper + digits + "_-", "letters_signs": upper + lower + "_-",
                 "base58": "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz", "base62": digits + upper + lower}
    drawn = {name: "".join(draw.choice(letters) for _ in range(44)) for name, letters in alphabets.items()}
    values = [*drawn.values(), "x7k2m9q4z8w1v5t3r6y0p2n4", "abcabcabcabc1abcabcabcabc1abcabcabcabc1", "onlylowercaseletterswithoutanydigit", "kebab-case-words-without-any-digit"]
    docs = spark.createDataFrame([(i, f"see {v} there") for i, v in enumerate(values)], "doc_id long, text string")
    found = {r["value"]: r["encoding"] for r in secrets.random_tokens(docs).collect()}
    names = {e[0] for e in secrets.ENCODINGS}
    # base58 and base62 have all three classes: they stay with base64, as before
    drawn = {v: n if n in names else "base64" for n, v in drawn.items()}
    assert found == drawn
    # letters and digits in turn are tested too, and dismissed
    tested = {r["value"]: r for r in secrets.randomness(spark.createDataFrame([(v,) for v in values], "value string")).collect()}
    assert {v: r["encoding"] for v, r in tested.items()} == drawn | {values[len(drawn)]: "base36", values[len(drawn) + 1]: "hex"}
    assert tested["x7k2m9q4z8w1v5t3r6y0p2n4"]["p_random"] < 0.05

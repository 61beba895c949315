"""Digits encrypted to as many digits: FF1 of NIST SP 800-38G with AES, as SQL expressions.

Ten rounds of a Feistel network over the two halves of the digits. The round function is AES over
two blocks: the first is the same in all rounds, and the second is encrypted with the first's
result as IV. Without tweak; from 6 to 36 digits.
"""

from __future__ import annotations

from maskwright.functions.spans import let, record

SHORTEST, LONGEST = 6, 36
ROUNDS = 10


def _cipher(digits: str, key: str, back: bool) -> str:
    """SQL for the encrypted (or decrypted) string of digits, whose length is known to be fit."""
    size, left = f"length({digits})", f"(length({digits}) div 2)"
    right = f"({size} - {left})"
    width = f"CAST(ceil(ceil({right} * 3.3219280948873626D) / 8) AS int)"  # bytes of a half
    head = f"concat(unhex('0102010000' || '0A0A'), unhex(lpad(hex({left}), 2, '0')), unhex(lpad(hex({size}), 8, '0')), unhex('00000000'))"
    first = f"substring(aes_encrypt({head}, {key}, 'ECB', 'PKCS'), 1, 16)"
    kept, other = ("acc.a", "acc.b") if back else ("acc.b", "acc.a")
    block = f"concat(unhex(repeat('00', 15 - {width})), unhex(lpad(hex(i), 2, '0')), unhex(lpad(hex(CAST({kept} AS bigint)), 2 * {width}, '0')))"
    hashed = f"hex(substring(aes_encrypt({block}, {key}, 'CBC', 'PKCS', mac), 17, if({width} > 4, 12, 8)))"
    high = f"coalesce(CAST(conv(left({hashed}, length({hashed}) - 16), 16, 10) AS decimal(20, 0)), 0)"
    low = f"CAST(conv(right({hashed}, 16), 16, 10) AS decimal(20, 0))"
    mixed = f"({high} * CAST('18446744073709551616' AS decimal(20, 0)) + {low})"
    span = f"if(i % 2 = 0, {left}, {right})"
    modulus = f"CAST(rpad('1', {span} + 1, '0') AS decimal(20, 0))"
    moved = f"pmod(CAST({other} AS decimal(20, 0)) {'-' if back else '+'} pmod({mixed}, {modulus}), {modulus})"
    text = f"lpad(CAST(CAST({moved} AS decimal(20, 0)) AS string), {span}, '0')"
    then = record(a=text, b="acc.a") if back else record(a="acc.b", b=text)
    begin = record(a=f"substring({digits}, 1, {left})", b=f"substring({digits}, {left} + 1, {right})")
    order = f"sequence({ROUNDS - 1}, 0)" if back else f"sequence(0, {ROUNDS - 1})"
    return let("mac", first, f"aggregate({order}, {begin}, (acc, i) -> {then}, acc -> concat(acc.a, acc.b))")


def encrypt_digits(digits: str, key: str = "enc_key") -> str:
    return _cipher(digits, key, False)


def decrypt_digits(digits: str, key: str = "enc_key") -> str:
    return _cipher(digits, key, True)


def _luhn_digit(digits: str) -> str:
    """The digit that makes a row of digits pass the Luhn test when it is put at the end."""
    twice = "CAST(substring(reversed, k, 1) AS int) * if(k % 2 = 1, 2, 1)"
    total = f"aggregate(sequence(1, length(reversed)), 0, (acc, k) -> acc + CAST(({twice}) div 10 + ({twice}) % 10 AS int))"
    return let("reversed", f"reverse({digits})", f"CAST(pmod(10 - {total} % 10, 10) AS string)")


def _with_digits(text: str, new: str) -> str:
    """``text`` with its digits replaced, one by one, by those of ``new``; all other signs stay."""
    before = f"length(regexp_replace(substring({text}, 1, k), '[^0-9]', ''))"
    each = f"if(substring({text}, k, 1) RLIKE '[0-9]', substring({new}, {before}, 1), substring({text}, k, 1))"
    return f"array_join(transform(sequence(1, length({text})), k -> {each}), '')"


def preserve(text: str, luhn: str, key: str = "enc_key", back: bool = False) -> str:
    """SQL for ``text`` with its digits encrypted and everything else in place; NULL if they are too few or too many.

    Where ``luhn`` (SQL) holds and the digits pass the Luhn test, all but the last are encrypted, and the
    last is computed from them, so that the result passes as well, and can be turned back.
    """
    cipher = decrypt_digits if back else encrypt_digits
    card = let("body", "left(digits, length(digits) - 1)", let("made", cipher("body", key), f"concat(made, {_luhn_digit('made')})"))
    fit = lambda n: f"length(digits) BETWEEN {SHORTEST + n} AND {LONGEST}"
    new = f"CASE WHEN {luhn} AND {fit(1)} AND luhn_check(digits) THEN {card} WHEN {fit(0)} THEN {cipher('digits', key)} END"
    plain = f"regexp_replace({text}, '[^0-9]', '')"
    return let("digits", plain, let("turned", new, f"if(turned IS NULL, NULL, {_with_digits(text, 'turned')})"))

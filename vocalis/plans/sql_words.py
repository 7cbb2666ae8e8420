"""Number words as DuckDB SQL, from base lists and arithmetic: independent of the Column functions' tables."""

from __future__ import annotations

from vocalis.kernel import english, russian


def words(items) -> str:
    return "[" + ",".join(f"'{w}'" for w in items) + "]"


EU, ET, EO = words(english.UNITS), words(english.TENS), words(english.ORDINAL_UNITS)
RU, RF = words(russian.UNITS), words(["ноль", "одна", "две", *russian.UNITS[3:]])
RT, RH = words(russian.TENS), words(russian.HUNDREDS)


def en_below(x: str) -> str:
    two = f"CASE WHEN ({x}) % 100 < 20 THEN {EU}[({x}) % 100 + 1] ELSE concat_ws(' ', {ET}[({x}) % 100 // 10 + 1], CASE WHEN ({x}) % 10 > 0 THEN {EU}[({x}) % 10 + 1] END) END"
    return f"concat_ws(' ', CASE WHEN ({x}) >= 100 THEN {EU}[({x}) // 100 + 1] || ' hundred' END, CASE WHEN ({x}) % 100 > 0 OR ({x}) = 0 THEN {two} END)"


def en(x: str) -> str:
    a = f"abs({x})"
    return f"(CASE WHEN ({x}) < 0 THEN 'minus ' ELSE '' END || concat_ws(' ', CASE WHEN {a} >= 1000000 THEN {en_below(f'{a} // 1000000')} || ' million' END, CASE WHEN {a} // 1000 % 1000 > 0 THEN {en_below(f'{a} // 1000 % 1000')} || ' thousand' END, CASE WHEN {a} % 1000 > 0 OR {a} = 0 THEN {en_below(f'{a} % 1000')} END))"


def en_ordinal_below_100(x: str) -> str:
    tens = words([t[:-1] + "ieth" for t in english.TENS])
    return f"CASE WHEN ({x}) < 20 THEN {EO}[({x}) + 1] WHEN ({x}) % 10 = 0 THEN {tens}[({x}) // 10 + 1] ELSE {ET}[({x}) // 10 + 1] || ' ' || {EO}[({x}) % 10 + 1] END"


def en_counted(x: str, one: str) -> str:
    return f"({en(x)} || CASE WHEN abs({x}) = 1 THEN ' {one}' ELSE ' {one}s' END)"


def en_year(x: str) -> str:
    return f"(CASE WHEN ({x}) BETWEEN 1000 AND 1999 THEN {en_below(f'({x}) // 100')} || ' ' || CASE WHEN ({x}) % 100 = 0 THEN 'hundred' ELSE {en_below(f'({x}) % 100')} END ELSE {en(x)} END)"


def en_digits(text: str) -> str:
    return f"array_to_string(list_transform(string_split({text}, ''), lambda c: {EU}[c::INT + 1]), ' ')"


def ru_below(x: str, fem: bool = False) -> str:
    u = RF if fem else RU
    return f"concat_ws(' ', CASE WHEN ({x}) >= 100 THEN {RH}[({x}) // 100 + 1] END, CASE WHEN ({x}) % 100 >= 20 THEN {RT}[({x}) % 100 // 10 + 1] END, CASE WHEN ({x}) % 100 >= 20 AND ({x}) % 10 > 0 THEN {u}[({x}) % 10 + 1] WHEN ({x}) % 100 < 20 AND (({x}) % 100 > 0 OR ({x}) = 0) THEN {u}[({x}) % 100 + 1] END)"


def ru_plural(x: str, forms) -> str:
    return f"CASE WHEN abs({x}) % 100 BETWEEN 11 AND 19 THEN '{forms[2]}' WHEN abs({x}) % 10 = 1 THEN '{forms[0]}' WHEN abs({x}) % 10 BETWEEN 2 AND 4 THEN '{forms[1]}' ELSE '{forms[2]}' END"


def ru(x: str, fem: bool = False) -> str:
    a = f"abs({x})"
    m, t = f"{a} // 1000000", f"{a} // 1000 % 1000"
    return f"(CASE WHEN ({x}) < 0 THEN 'минус ' ELSE '' END || concat_ws(' ', CASE WHEN {m} > 0 THEN {ru_below(m)} || ' ' || {ru_plural(m, russian.MILLION)} END, CASE WHEN {t} > 0 THEN {ru_below(t, True)} || ' ' || {ru_plural(t, russian.THOUSAND)} END, CASE WHEN {a} % 1000 > 0 OR {a} = 0 THEN {ru_below(f'{a} % 1000', fem)} END))"


def ru_counted(x: str, forms, fem: bool = False) -> str:
    return f"({ru(x, fem)} || ' ' || {ru_plural(x, forms)})"


def ru_ordinal_below_100(x: str, case: str) -> str:
    end = lambda stems: words(["-" if s == "-" else russian._ended(s, case) for s in stems])
    units, tens = end(russian.ORDINAL_UNITS), end(russian.ORDINAL_TENS)
    return f"CASE WHEN ({x}) < 20 THEN {units}[({x}) + 1] WHEN ({x}) % 10 = 0 THEN {tens}[({x}) // 10 + 1] ELSE {RT}[({x}) // 10 + 1] || ' ' || {units}[({x}) % 10 + 1] END"


def ru_year(x: str, case: str) -> str:
    end = lambda stems: words(["-" if s == "-" else russian._ended(s, case) for s in stems])
    head = f"CASE WHEN ({x}) // 1000 = 1 THEN 'тысяча' ELSE {RF}[({x}) // 1000 + 1] || ' ' || {ru_plural(f'({x}) // 1000', russian.THOUSAND)} END"
    return f"""CASE WHEN ({x}) % 1000 = 0 THEN {end(russian.ORDINAL_THOUSANDS)}[({x}) // 1000 + 1]
 WHEN ({x}) % 100 = 0 THEN {head} || ' ' || {end(russian.ORDINAL_HUNDREDS)}[({x}) % 1000 // 100 + 1]
 ELSE concat_ws(' ', {head}, CASE WHEN ({x}) % 1000 >= 100 THEN {RH}[({x}) % 1000 // 100 + 1] END, {ru_ordinal_below_100(f'({x}) % 100', case)}) END"""


def ru_decimal2(whole: str, part: str) -> str:
    """With two digits after the comma; part is their number."""
    return f"({ru(whole, True)} || CASE WHEN {ru_plural(whole, ('1', '2', '2'))} = '1' THEN ' целая ' ELSE ' целых ' END || {ru(part, True)} || CASE WHEN {ru_plural(part, ('1', '2', '2'))} = '1' THEN ' сотая' ELSE ' сотых' END)"

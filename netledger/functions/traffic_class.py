"""Organisation and category of a host name or an address: one CASE per label, written out from the rule tables.

The CASE is SQL text over a named column: a few hundred branches are parsed at once instead of being put together
object by object.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from netledger.functions import rule_tables as tables
from netledger.functions.timebins import as_col
from netledger.params import PEER_TO_PEER, UNKNOWN_NO_DNS, UNKNOWN_NOT_MAPPED


def _text(value: str) -> str:
    return "'" + value.replace("'", "\\'") + "'"


def _matches(column: str, pattern: str) -> str:
    return f"`{column}` RLIKE r'{pattern}'"


def _any_token(column: str, tokens: list[str]) -> str:
    """Some token occurs; a leading ^ ties a token to the start."""
    return _matches(column, "|".join("^" * t.startswith("^") + re.escape(t.removeprefix("^")) for t in tokens))


def _case(branches: list[tuple[str, str]], default: str) -> str:
    """The first branch that holds wins."""
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in branches) + f" ELSE {default} END"


def _last_pattern(column: str, table: str, folds: dict[str, str], default: str) -> str:
    rules = tables.patterns(table)
    return _case([(_matches(column, p), _text(folds.get(c, c))) for p, c in reversed(rules)], default)


def _first_token(column: str, table: str, field: int, default: str) -> str:
    branches = []
    for rule in tables.token_rules(table):
        test = _any_token(column, rule[0])
        if rule[1]:
            test += f" AND {_any_token(column, [rule[1]])}"
        branches.append((test, _text(rule[field])))
    return _case(branches, _text(default))


def _domain_case(column: str, google: str, facebook: str, field: int) -> Column:
    gate = lambda tokens: _any_token(column, tokens.split(", "))
    return F.expr(_case(
        [
            (f"coalesce(`{column}`, '') = ''", _text(UNKNOWN_NO_DNS)),
            (gate(tables.GOOGLE_GATE), google),
            (gate(tables.FACEBOOK_GATE), facebook),
        ],
        _first_token(column, tables.DOMAIN_TOKENS, field, UNKNOWN_NOT_MAPPED),
    ))


def domain_org(column: str) -> Column:
    return _domain_case(column, _text("Google"), _text("Facebook"), 2)


def domain_category(column: str) -> Column:
    fallback = _case(
        [(_matches(column, tables.GOOGLE_FALLBACK_PATTERN), _text(tables.GOOGLE_FALLBACK_CATEGORY))],
        _text(UNKNOWN_NOT_MAPPED),
    )
    google = _last_pattern(column, tables.GOOGLE_PATTERNS, tables.GOOGLE_FOLDS, fallback)
    facebook = _last_pattern(column, tables.FACEBOOK_PATTERNS, tables.FACEBOOK_FOLDS, _text(UNKNOWN_NOT_MAPPED))
    return _domain_case(column, google, facebook, 3)


def address_org(column: str) -> Column:
    return F.expr(_first_token(column, tables.ADDRESS_TOKENS, 2, UNKNOWN_NO_DNS))


def address_category(column: str) -> Column:
    return F.expr(_first_token(column, tables.ADDRESS_TOKENS, 3, UNKNOWN_NO_DNS))


def name_spells_address(ip: Column | str, fqdn: Column | str) -> Column:
    """Each dotted part of the address occurs somewhere in the name: a subscriber host of an access network."""
    return F.forall(F.split(as_col(ip), r"\."), lambda part: as_col(fqdn).contains(part))


PASSTHROUGH_ORG, PASSTHROUGH_CATEGORY = "Peer (Unknown Org)", PEER_TO_PEER

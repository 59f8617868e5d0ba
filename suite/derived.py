"""Text with identifiers, derived from table keys by SQL that Spark and DuckDB both read."""

from __future__ import annotations


def _div(value: str, by: int) -> str:
    return f"CAST(floor({value} / {by}.0) AS BIGINT)"


def _letter(value: str, shift: int) -> str:
    return f"chr(CAST(65 + ({value}) % 26 AS INT))" if shift == 0 else f"chr(CAST(65 + {_div(value, 26 ** shift)} % 26 AS INT))"


def _digits(value: str, width: int) -> str:
    return f"lpad(CAST(({value}) % {10 ** width} AS STRING), {width}, '0')"


K = "c_custkey"
PAN = f"concat({_letter(K, 0)}, {_letter(K, 1)}, {_letter(K, 2)}, 'PK', {_digits(f'{K} * 37', 4)}, {_letter(f'{K} * 5', 0)})"
IFSC = f"concat('HD', {_letter(K, 1)}, {_letter(K, 0)}, '0', {_digits(f'{K} * 91', 6)})"
PASSPORT = f"concat({_letter(f'{K} * 3', 0)}, CAST({K} % 9 + 1 AS STRING), {_digits(f'{K} * 7331', 6)})"
DOMAIN = f"split_part('upi,ybl,ibl,axl,paytm,okhdfcbank,okicici,oksbi,okaxis,gmail', ',', CAST({K} % 10 + 1 AS INT))"
HANDLE = f"concat('user.', CAST({K} AS STRING))"
EMAIL = f"concat({HANDLE}, '@mail', CAST({K} % 7 AS STRING), '.example.com')"
IBAN = f"concat('DE', {_digits(f'{K} * 13', 2)}, {_digits(f'{K} * 104729', 9)}, {_digits(f'{K} * 611953', 9)})"
IPV6 = f"concat('2001:db8:0:1:', {_digits(K, 4)}, ':0:', {_digits(f'{K} * 17', 4)}, ':1')"
LABEL = "CASE WHEN c_nationkey < 8 THEN 'PAN' WHEN c_nationkey < 16 THEN 'Ref' ELSE 'Company' END"
PASS_LABEL = "CASE WHEN c_nationkey % 2 = 0 THEN 'Passport number' ELSE 'Booking with a number that is' END"

CUSTOMER_TEXT = f"""concat(
 'Full name: ', {_letter(K, 0)}, 'arav ', {_letter(K, 1)}, 'harma', chr(10),
 {LABEL}, ' ', {PAN}, ' filed for segment ', c_mktsegment, '. ',
 'Branch code ', {IFSC}, ' and payment handle ', {HANDLE}, '@', {DOMAIN}, ' are on record for the period; ',
 {PASS_LABEL}, ' ', {PASSPORT}, ' was shown at the counter, reply to ', {EMAIL}, '.', chr(10),
 'Home Address: ', CAST({K} % 97 + 1 AS STRING), ' MG Road, Ward ', CAST(c_nationkey AS STRING), '; ',
 'Flat ', CAST({K} % 40 + 1 AS STRING), ', Park Street, Kolkata ', {_digits(f'{K} * 7 + 100000', 6)}, chr(10),
 'IBAN ', {IBAN}, ' from host ', {IPV6}, ' as ', c_name)"""

O = "o_orderkey"
TWELVE = f"concat(CAST({O} % 8 + 2 AS STRING), {_digits(f'{O} * 7919 + 31', 11)})"
AADHAAR = (
    f"CASE WHEN o_orderstatus = 'F' THEN concat(substr({TWELVE}, 1, 4), ' ', substr({TWELVE}, 5, 4), ' ', substr({TWELVE}, 9, 4))"
    f" ELSE {TWELVE} END"
)
ACCOUNT = f"{_digits(f'{O} * 48271 + 900719925474', 18)}"
ACCOUNT_CUT = f"substr({ACCOUNT}, CAST({O} % 9 + 1 AS INT))"
MOBILE = f"concat(CAST({O} % 10 AS STRING), {_digits(f'{O} * 6113 + 12345', 9)})"
ORDER_TEXT = f"""concat(
 'Order ', CAST({O} AS STRING), ' priority ', o_orderpriority, ' placed ', substr(CAST(o_orderdate AS STRING), 1, 10),
 ' with aadhaar ', {AADHAAR}, ' on file, ',
 CASE WHEN o_orderstatus = 'O' THEN 'ledger ' ELSE 'bank account ' END, {ACCOUNT_CUT},
 ' and contact phone ', CASE WHEN {O} % 3 = 0 THEN '' WHEN {O} % 3 = 1 THEN '+91 ' ELSE '91' END, {MOBILE}, '.')"""

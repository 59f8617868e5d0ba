"""Our own small texts, after the shapes the rules are meant for. All identifiers are invented."""

AADHAAR = "234567890124"  # passes the checksum
AADHAAR_TOO = "345678901238"
AADHAAR_BAD = "234567890123"

PROFILE = """New customer sheet
==================
Full Name: Asha Verma
Contact Email: asha.verma@example.in
Contact Phone: +91 9876543210
Aadhaar Number: 2345 6789 0124
PAN: ABCDE1234F
Passport: K1234567
UPI VPA: asha.verma@upi
IFSC: HDFC0001234
Beneficiary Account Number: 123456789012
Home Address: 22 MG Road, Bengaluru, Karnataka
"""
EXPORT = """{ "users": [ { "name": "Asha Verma", "email": "asha.verma@example.in", "mobile": "+91 9876543210",
  "pan": "ABCDE1234F", "aadhaar": "234567890124", "upi": "asha.verma@upi",
  "ifsc": "HDFC0001234", "account": "123456789012" } ] }
"""
NEAR_MISSES = """Things that look like identifiers:
- wrong check digit in aadhaar 234567890123
- pan of the wrong shape ABCD1234F, ABCDE12345
- upi without a known domain name(at)bank
- ifsc too short HDFC001234
- mobile with a bad first digit +91 5123456789
"""
REPEATED = """Repeated values
asha.verma@example.in
asha.verma@example.in
asha.verma@example.in
PAN ABCDE1234F and once more ABCDE1234F
Aadhaar 2345 6789 0124 then 2345 6789 0124
"""
HARMLESS = """Weekly notes:
- Uptime stayed above target and latency fell after cache tuning.
- version 1.2.3, depth=7, error rate 0.12
"""

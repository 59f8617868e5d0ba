"""Spark-native discovery of personal data in files, text tables and columns."""

from .operators.recognisers import Pattern, Recogniser
from .plans.config import ScanSpec, load_spec
from .plans.scan import ScanResult, scan_records
from .rules import EntityRule, RuleSet

__all__ = ["EntityRule", "Pattern", "Recogniser", "RuleSet", "ScanResult", "ScanSpec", "load_spec", "scan_records"]

"""The six questions as named tools for an agent host to call.

Transport is the host's business; this module has the names, the inputs and the answers.
Zero means the default.
"""

from .functions.scoring import DEFAULT_CHAR_BUDGET, DEFAULT_LIST_BUDGET
from .plans import report
from .streaming.host import Host


class Tools:
    """Builds the index once at start, so a broken repository fails at once."""

    def __init__(self, host: Host):
        self.host = host
        host.current()

    def terra_explore(self, query: str, maxNodes: int = 0, charBudget: int = 0) -> str:
        """Retrieve configuration for a question, an address, a type or a module name."""
        return report.explore_text(self.host.current(), query, maxNodes or 5, charBudget or DEFAULT_CHAR_BUDGET)

    def terra_for_address(self, address: str, charBudget: int = 0) -> str:
        """Every expression that references an address; mentions in text do not count."""
        return report.for_address_text(self.host.current(), address, charBudget or DEFAULT_LIST_BUDGET)

    def terra_impact(self, address: str, direction: str = "", depth: int = 0, charBudget: int = 0) -> str:
        """Everything reachable from an address, and how much the answer knows."""
        way = "dependencies" if direction == "dependencies" else "dependents"
        return report.impact_text(self.host.current(), address, way, depth or 3, charBudget or DEFAULT_LIST_BUDGET)

    def terra_modules(self, filter: str = "", charBudget: int = 0) -> str:
        """Module sources and versions, version skew first."""
        return report.modules_text(self.host.current(), filter, charBudget or DEFAULT_LIST_BUDGET)

    def terra_orphans(self, charBudget: int = 0) -> str:
        """Variables, locals and child outputs that nothing reads."""
        return report.orphans_text(self.host.current(), charBudget or DEFAULT_LIST_BUDGET)

    def terra_status(self) -> str:
        """The shape of the index, unresolved references, parse errors and overlay coverage."""
        return report.status_text(self.host.current(), self.host.repo_root, self.host.builds)

"""What can be refused, with one root."""


class LodestoneError(Exception):
    pass


class IdentityError(LodestoneError):
    pass


class BlockIntegrityError(LodestoneError):
    pass


class AppendOnlyViolation(LodestoneError):
    pass


class RetentionPolicyError(LodestoneError):
    pass


class MembershipError(LodestoneError):
    pass


class SnapshotError(LodestoneError):
    pass


class QueryError(LodestoneError):
    pass


class DistributionError(LodestoneError):
    pass


class DivergenceError(DistributionError):
    pass


class ReconciliationError(LodestoneError):
    pass


class NoCommonAncestor(ReconciliationError):
    pass


class ReconciliationHalted(ReconciliationError):
    pass


class ResolutionRefused(ReconciliationError):
    pass


class LayoutError(LodestoneError):
    """A tree layout that is not known here."""

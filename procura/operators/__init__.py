"""DataFrame operators: substring join, matching, tiers, links, report."""

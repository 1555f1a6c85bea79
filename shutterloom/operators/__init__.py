"""DataFrame operators: each module declares plans and leaves the physical strategy to Catalyst."""

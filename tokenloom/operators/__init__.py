"""DataFrame operators; every module names the inventory rows that it covers."""

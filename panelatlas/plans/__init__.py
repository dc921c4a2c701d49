"""Query plans over the contract tables, and their registry."""

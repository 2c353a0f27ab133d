"""The registered queries: each applies operators to the driver's tables and has, where SQL can say it, an oracle."""

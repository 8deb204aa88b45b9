"""Training-data operators: each module holds one, registry.py names their queries."""

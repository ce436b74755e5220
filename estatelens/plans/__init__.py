"""Rule packs, composed jobs and the registered queries."""

"""Layer builders: bronze, silver, marts, deliveries and the gated run."""

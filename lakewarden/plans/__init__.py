"""From a dataset document to Catalyst plans: configuration, templating, contract, rules, reports, audit."""

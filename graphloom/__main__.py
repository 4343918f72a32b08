import sys

from graphloom.plans.cli import main

sys.exit(main())

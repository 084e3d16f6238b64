"""Word lists of the node filter and of keyword extraction, by length and ending."""

PRONOUNS = frozenset("""
i he me we us it my she one all him who her our his its you any some mine none each both them whom your ones this
hers ours that what they these those whose which other their yours anyone itself myself theirs someone himself
herself nothing another everyone yourself anything something ourselves everything themselves yourselves
""".split()) | {"no one"}

VAGUE_NOUNS = frozenset("""
era job end age tie use aim map top set bit law way idea area data kind bond face side edge role rule time zone type
here case rate site size back link work task goal item room term form norm plan span turn step eras jobs ends ages
ties uses aims maps tops sets bits laws ways fact unit plot spot part sort test list view show copy duty topic field
blend trend round place space piece image stage range scale table cycle there phase sense cause value issue above
stuff proof thing epoch graph block chunk trial model level skill ratio photo group order paper layer ideas areas
kinds bonds faces sides edges roles rules times zones types bases cases rates sites sizes basis backs links tasks
goals items rooms terms forms norms means plans spans turns steps class facts units plots spots parts sorts tests
lists views shows event point front chart start below array study ground method period record choice device source
inside degree change middle sample scheme centre figure nature update belief finish detail system bottom domain
origin region action option reason number manner center answer factor sector topics fields blends trends rounds
places spaces pieces images stages ranges copies series duties scales tables cycles phases senses causes values
issues proofs things epochs graphs blocks chunks trials models levels skills ratios photos groups orders layers
events points fronts charts starts arrays impact effect object aspect target result moment extent amount effort
report review matrix survey theory entity surface essence outside article example outcome routine nowhere failure
measure feature picture mixture purpose finding meaning setting diagram program problem opinion version section
edition portion pattern barrier polymer grounds methods periods records choices devices sources insides degrees
changes studies middles samples schemes centres figures classes updates beliefs details systems bottoms domains
origins regions actions options reasons numbers centers answers factors sectors success process impacts effects
objects aspects targets results moments amounts efforts reports reviews surveys subject project insight benefit
instant element segment content account concept attempt support context display summary inquiry quality ability
criteria compound standard practice instance evidence sequence variable obstacle particle anywhere exercise response
modeling approach research drawback material interval protocol specimen revision location relation duration reaction
function position question solution interior exterior behavior surfaces matrices outsides finishes theories entities
examples outcomes routines failures measures features pictures mixtures purposes findings meanings settings analysis
diagrams programs problems opinions versions sections editions portions patterns barriers polymers progress subjects
projects insights benefits instants elements segments contents accounts concepts attempts contexts displays fragment
document contrast overview tendency strategy boundary category capacity quantity activity property interface
substance relevance influence advantage knowledge challenge principle programme guideline somewhere procedure
structure composite attribute technique objective modelling beginning framework potential criterion variation
operation situation condition intention parameter behaviour compounds standards practices instances sequences
summaries inquiries qualities abilities variables obstacles particles exercises responses successes processes
modelings drawbacks materials intervals protocols specimens revisions locations relations durations reactions
functions positions questions solutions interiors exteriors behaviors awareness fragments documents contrasts
overviews component viewpoint territory background importance difference percentage everywhere initiative photograph
conclusion foundation simulation estimation limitation evaluation motivation collection connection correction
prediction completion exhibition assumption comparison interfaces substances influences advantages challenges
approaches tendencies strategies boundaries categories capacities quantities activities properties principles
programmes guidelines procedures structures hypotheses composites attributes techniques objectives modellings
beginnings hypothesis frameworks variations operations situations conditions intentions parameters behaviours
components viewpoints experiment assignment assessment adjustment constraint efficiency simplicity capability
similarity complexity difficulty performance alternative perspective application association correlation calculation
formulation information explanation combination examination exploration expectation computation observation
interaction restriction composition description backgrounds differences percentages territories initiatives
photographs conclusions foundations simulations estimations limitations evaluations motivations collections
connections corrections predictions exhibitions assumptions comparisons experiments assignments assessments
adjustments constraints enhancement arrangement requirement measurement improvement environment development
possibility significance circumstance disadvantage modification illustration presentation organization introduction
relationship capabilities similarities complexities difficulties alternatives perspectives applications associations
correlations calculations formulations explanations combinations examinations explorations expectations computations
observations interactions restrictions compositions descriptions enhancements arrangements requirements measurements
improvements environments developments understanding specification investigation approximation determination
demonstration configuration circumstances disadvantages possibilities modifications illustrations presentations
organizations introductions relationships effectiveness characteristic representation specifications investigations
approximations determinations demonstrations configurations responsibility characteristics representations
responsibilities
""".split()) | {"material formulation"}

AUTHOR_TERMS = frozenset("""
lab team labs group teams author groups authors scientist researcher scientists laboratory researchers investigator
laboratories investigators
""".split())

STOPWORDS = frozenset("""
a i be he me we of an in on do no so to or as is us at it by my had did and she the are all him can own who too her
for nor our has was his its not but you few how now may why once same some here were more have each such with will
them whom from than been then when also into your does this that what most just must they only very could would
there where these those above being which shall again under other after their might about below should before during
through between further
""".split())
